"""The query language: text to plans.

    SELECT * | item, ...  FROM stream  [INNER JOIN target ON a (= | !=) b]  [WHERE column op literal]  [GROUP BY column, ...]
    CREATE TABLE | STREAM name (column TYPE, ...) [WITH (key = "value", ...)]

An item is a column or COUNT, SUM, AVG, MAX, MIN of one. Keywords are upper case. A semicolon may end the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

FUNCTIONS = ("COUNT", "SUM", "AVG", "MAX", "MIN")
TYPES = ("INT", "FLOAT", "STRING", "TIMESTAMP", "BOOLEAN")
KEYWORDS = {"SELECT", "FROM", "INNER", "JOIN", "ON", "WHERE", "GROUP", "BY", "CREATE", "TABLE", "STREAM", "WITH", *FUNCTIONS, *TYPES}
_TOKEN = re.compile(r'\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<text>"(?:[^"\\]|\\.)*")|(?P<sign>!=|>=|<=|[><=(),*;]))')


class QueryError(ValueError):
    """The text is not a query, or a query does not fit what is declared."""


@dataclass(frozen=True)
class Item:
    field: str
    func: str | None = None

    @property
    def name(self) -> str:
        return f"{self.func}({self.field})" if self.func else self.field


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: int | float | str


@dataclass(frozen=True)
class Join:
    target: str
    left: str
    op: str
    right: str


@dataclass(frozen=True)
class Select:
    select: tuple[Item, ...]
    source: str
    star: bool = False
    join: Join | None = None
    where: Condition | None = None
    group_by: tuple[str, ...] = ()

    @property
    def aggregates(self) -> tuple[Item, ...]:
        return tuple(dict.fromkeys(i for i in self.select if i.func))

    @property
    def keys(self) -> tuple[str, ...]:
        """Grouping columns: the GROUP BY list, or else the bare columns beside an aggregate."""
        return self.group_by or tuple(dict.fromkeys(i.field for i in self.select if not i.func))


@dataclass(frozen=True)
class Create:
    kind: str
    name: str
    columns: tuple[tuple[str, str], ...]
    options: dict[str, str] = field(default_factory=dict)


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"cannot read the query from {text[at:].strip()[:20]!r} on")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in wanted and self.tokens[self.at][0] != "text"

    def take(self, *wanted: str) -> str:
        if not self.peek(*wanted):
            found = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise QueryError(f"expected {' or '.join(wanted)}, found {found}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def accept(self, *wanted: str) -> bool:
        if self.peek(*wanted):
            self.at += 1
            return True
        return False

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name" or self.tokens[self.at][1] in KEYWORDS:
            found = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise QueryError(f"expected a name, found {found}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def listed(self, one):
        out = [one()]
        while self.accept(","):
            out.append(one())
        return tuple(out)

    def text(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "text":
            raise QueryError("expected a text in double quotes")
        self.at += 1
        return self.tokens[self.at - 1][1][1:-1]

    def literal(self) -> int | float | str:
        kind, raw = self.tokens[self.at] if self.at < len(self.tokens) else ("", "the end")
        if kind == "text":
            return self.text()
        if kind != "number":
            raise QueryError(f"expected a number or a text in double quotes, found {raw}")
        self.at += 1
        return float(raw) if re.search("[.eE]", raw) else int(raw)


def _item(r: _Reader) -> Item:
    for func in FUNCTIONS:
        if r.accept(func):
            r.take("(")
            inner = r.name()
            r.take(")")
            return Item(inner, func)
    return Item(r.name())


def _select(r: _Reader) -> Select:
    r.take("SELECT")
    star = r.accept("*")
    items = () if star else r.listed(lambda: _item(r))
    r.take("FROM")
    source, join, where, group = r.name(), None, None, ()
    if r.accept("INNER"):
        r.take("JOIN")
        target = r.name()
        r.take("ON")
        left, op = r.name(), None
        op = r.take("=", "!=")
        join = Join(target, left, op, r.name())
    if r.accept("WHERE"):
        column, op = r.name(), r.take(">=", "<=", "!=", ">", "<", "=")
        where = Condition(column, op, r.literal())
    if r.accept("GROUP"):
        r.take("BY")
        group = r.listed(r.name)
    return Select(items, source, star, join, where, group)


def _create(r: _Reader) -> Create:
    r.take("CREATE")
    kind, name = r.take("TABLE", "STREAM"), r.name()
    r.take("(")
    columns = r.listed(lambda: (r.name(), r.take(*TYPES)))
    r.take(")")
    options: dict[str, str] = {}
    if r.accept("WITH"):
        r.take("(")

        def option() -> tuple[str, str]:
            key = r.name()
            r.take("=")
            return key, r.text()

        options = dict(r.listed(option))
        r.take(")")
    return Create(kind, name, columns, options)


def parse(text: str) -> Select | Create:
    """One statement."""
    found = parse_all(text)
    if len(found) != 1:
        raise QueryError(f"expected one statement, found {len(found)}")
    return found[0]


def parse_all(text: str) -> list[Select | Create]:
    """Statements one after another, with or without semicolons between them."""
    r, out = _Reader(text), []
    while r.at < len(r.tokens):
        out.append(_create(r) if r.peek("CREATE") else _select(r))
        while r.accept(";"):
            pass
    return out
