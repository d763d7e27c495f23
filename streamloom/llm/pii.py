"""Surrogates for personal data, in DataFrame operations only.

Entities are found by patterns and named by a normal form: names and addresses in lower case, numbers by their digits, all else as it stands. Each normal form gets one
surrogate, and every occurrence is replaced by that surrogate in its own spelling, so spellings of one entity stay one, everywhere.

Names are replaced word by word, so that a family name alone still points to the full name, by made-up names of the same script and gender; words of a name that was found behind a title are replaced in the
rest of their document, too. All else goes through a keyed permutation of the strings of its format (a Feistel network, character by character, each of its class): length, case, separators and check digit stay,
and different entities of a format get different surrogates by construction. A surrogate that is itself an entity of the corpus, or taken, is drawn again; where a format is so
full that ATTEMPTS draws all fail, it is widened by characters more, so there always is a free one.

Patterns find no names without a title, and no addresses of houses.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, row_key, split_by_keys

# Titles that say a gender, with the scripts that names after them are in.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "Κα")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "Κος")
NEUTRAL = ("Dr", "Prof")
# What names are made of, by script, and how they end by gender.
SYLLABLES = {
    "latin": ("b d f g k l m n p r s t v z", "a e i o u", {"f": "a", "m": "o", "n": "en"}),
    "cyrillic": ("б в г д з к л м н п р с т", "а е и о у", {"f": "а", "m": "ий", "n": "енко"}),
    "greek": ("β γ δ ζ κ λ μ ν π ρ σ τ", "α ε ι ο υ", {"f": "α", "m": "ος", "n": "ου"}),
}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}[\p{L}'’-]+"
# Secrets come first: their values may look like other kinds.
_HEX = "[0-9A-Fa-f]{1,4}"
# Secrets come first: their values may look like other kinds.
KINDS = {
    "SECRET": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_./+~-]{6,}",
    "EMAIL": r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,5}\.[A-Za-z]{2,}",
    "IP": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "IP6": rf"(?<![\w:])(?=[A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\w:])",
    "KEY": r"\bAKIA[0-9A-Z]{16}\b|\b[0-9a-f]{32,64}\b",
    "IBAN": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CARD": r"\b\d{4}(?: \d{4}){2} \d{1,7}\b|\b\d{4}(?:-\d{4}){2}-\d{1,7}\b|\b\d{13,19}\b",
    "PHONE": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}\b|\(\d{3}\) ?\d{3}-\d{4}\b|\b\d{3}[.-]\d{3}[.-]\d{4}\b",
    "PERSON": rf"(?<!\p{{L}})(?:{'|'.join(sorted((*FEMALE, *MALE, *NEUTRAL), key=len, reverse=True))})\.? {_NAME}(?: {_NAME})?",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: What of a match stays as it is.
KEEP = {
    "SECRET": r"^(?i:(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?)",
    "KEY": r"^AKIA",
    "PHONE": r"^\+\d{1,3}(?=[ .(-])",
    "IBAN": r"^[A-Z]{2}",
}
#: Kinds whose spellings differ in case, and those that are their letters and digits, however these are parted.
CASELESS, PARTED = ("EMAIL", "IP6"), ("PHONE", "CARD", "SSN", "IBAN")
#: Draws within the format, before it is widened; and rounds of the permutation.
ATTEMPTS, ROUNDS = 3, 4
DOC = ["doc_id", "key"]


def _kind(match: Column) -> Column:
    out = F.lit("PERSON")
    for kind in reversed([k for k in KINDS if k != "PERSON"]):
        out = F.when(match.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    return out


def _units(match: Column, kind: Column) -> Column:
    """The parts of a match: (kind, value, norm, gender), with kind null for what stays."""

    def unit(k: Column, value: Column, norm: Column | None = None, gender: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(k.alias("kind"), value.alias("value"), (none if norm is None else norm).alias("norm"), (none if gender is None else gender).alias("gender"))

    same = F.lit(None).cast("string")
    w = F.split(match, " ")
    bare = F.rtrim(F.get(w, 0), F.lit("."))
    gender = F.when(bare.isin(*FEMALE), "f").when(bare.isin(*MALE), "m").otherwise("n")
    name = lambda v, g: unit(F.lit("NAME"), v, F.lower(v), g)
    title = unit(same, F.concat(F.get(w, 0), F.lit(" ")))
    person = F.when(F.size(w) == 3, F.array(title, name(F.get(w, 1), gender), unit(same, F.lit(" ")), name(F.get(w, 2), F.lit("n")))).otherwise(F.array(title, name(F.get(w, 1), F.lit("n"))))
    kept = F.lit("")
    for k, pattern in KEEP.items():
        kept = F.when(kind == k, F.regexp_extract(match, pattern, 0)).otherwise(kept)
    rest = F.substring(match, F.length(kept) + 1, F.length(match))
    norm = F.when(kind.isin(*CASELESS), F.lower(rest)).when(kind.isin(*PARTED), F.regexp_replace(rest, "[^0-9A-Z]", "")).otherwise(rest)
    return F.when(kind == "PERSON", person).otherwise(F.array(unit(same, kept), unit(kind, rest, norm)))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, m, u, kind, value, norm, gender): the parts u of the m-th match of each row; kind is null for parts that stay. Wholly equal rows have theirs once."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        row_key(F.col(text_col)).alias("key"),
        F.posexplode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(PATTERN), F.lit(0))).alias("m", "match"),
    )
    kinds = rows.withColumn("kind", _kind(F.col("match")))
    parts = kinds.select(*DOC, "m", F.posexplode(_units(F.col("match"), F.col("kind"))).alias("u", "part"))
    return parts.select(*DOC, "m", "u", "part.*").distinct()


def _hmac(secret: str, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal digits."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def _draw(secret: str, *of: Column) -> Column:
    """A keyed number from 0 to 2^32 - 1."""
    return F.conv(F.substring(_hmac(secret, F.concat_ws("\x1f", *(c.cast("string") for c in of))), 1, 8), 16, 10).cast("long")


def _class(c: Column, hexed: Column) -> Column:
    """What a character may become: 0, a, A and h stand for ten digits, small letters, capitals, and sixteen digits; all else stays."""
    return F.when(hexed & c.rlike("^[0-9a-f]$"), "h").when(c.rlike("^[0-9]$"), "0").when(c.rlike("^[a-z]$"), "a").when(c.rlike("^[A-Z]$"), "A").otherwise(c)


SIXTEEN = "0123456789abcdef"


def permuted(secret: str, kind: Column, text: Column, attempt: Column) -> Column:
    """`text` through a keyed permutation of the texts of its format (kind and class of each character): half by half, each character turned by a number that the other half and the key give.

    Of an address the last part of the domain stays. The octets of an IP address count as characters of 256 values.
    """
    is_ip = kind == "IP"
    kept = F.when(kind == "EMAIL", F.regexp_extract(text, r"\.[A-Za-z]{2,}$", 0)).otherwise("")
    body = F.substring(text, F.lit(1), F.length(text) - F.length(kept))
    hexed = kind.isin("KEY", "IP6") & body.rlike("^[0-9a-f:]+$")
    parts = F.when(is_ip, F.split(body, r"\.")).otherwise(F.split(body, ""))
    classes = F.transform(parts, lambda c: F.when(is_ip, "i").otherwise(_class(c, hexed)))
    size = lambda k: F.when(k == "i", 256).when(k == "h", 16).when(k == "0", 10).when(k.isin("a", "A"), 26).otherwise(1)
    value = F.zip_with(
        parts, classes,
        lambda c, k: F.when(k == "i", F.expr("0") + c.try_cast("int")).when(k == "h", F.instr(F.lit(SIXTEEN), c) - 1).when(k == "0", c.try_cast("int")).when(k == "a", F.ascii(c) - 97).when(k == "A", F.ascii(c) - 65).otherwise(0),
    )
    form = F.concat_ws("", classes)
    start = F.struct(value.alias("v"), classes.alias("k"), F.concat_ws("\x1f", kind, form, kept, attempt.cast("string")).alias("tweak"), F.size(classes).alias("n"))

    def turn(acc: Column, r: Column) -> Column:
        half = F.floor((acc["n"] + 1) / 2).cast("int")
        first = r % 2 == 0
        other = F.concat_ws(",", F.when(first, F.slice(acc["v"], half + 1, acc["n"])).otherwise(F.slice(acc["v"], F.lit(1), half)))
        moves = lambda i: F.when(first, i < half).otherwise(i >= half)
        at = lambda i: F.get(acc["v"], i)
        one = lambda k, i: F.when((size(k) > 1) & moves(i), ((at(i) + _draw(secret, acc["tweak"], r, other, i)) % size(k)).cast("int")).otherwise(at(i))
        return F.struct(F.transform(acc["k"], one).alias("v"), acc["k"].alias("k"), acc["tweak"].alias("tweak"), acc["n"].alias("n"))

    def spell(acc: Column) -> Column:
        chars = F.zip_with(
            acc["v"], acc["k"],
            lambda x, k: F.when(k == "i", x.cast("string")).when(k == "h", F.substring(F.lit(SIXTEEN), x + 1, F.lit(1))).when(k == "0", x.cast("string")).when(k == "a", F.char(x + 97)).when(k == "A", F.char(x + 65)).otherwise(k),
        )
        return F.when(is_ip, F.array_join(chars, ".")).otherwise(F.array_join(chars, ""))

    return F.concat(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, spell), kept)


def check_digit(bare: Column) -> Column:
    """The digit that makes `bare`, with any last digit, pass Luhn's test."""
    at = F.sequence(F.lit(2), F.length(bare))
    value = lambda i: F.substring(bare, F.length(bare) - i + 1, F.lit(1)).cast("int")
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i)))
    return ((10 - total % 10) % 10).cast("string")


def made_up(secret: str, norm: Column, gender: Column, attempt: Column) -> Column:
    """A name in small letters with the script of `norm` and the gender's ending: three syllables, and one more for each draw after the first."""
    script = F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    out = F.lit(None).cast("string")
    for name, (consonants, vowels, ends) in SYLLABLES.items():
        cs, vs = (F.array(*map(F.lit, x.split())) for x in (consonants, vowels))
        pick = lambda xs, n: F.get(xs, (_draw(secret, F.lit("NAME"), norm, attempt, n) % F.size(xs)).cast("int"))
        syllables = F.transform(F.sequence(F.lit(0), attempt + 2), lambda k: F.concat(pick(cs, 2 * k), pick(vs, 2 * k + 1)))  # noqa: B023
        end = F.when(gender == "f", ends["f"]).when(gender == "m", ends["m"]).otherwise(ends["n"])
        out = F.when(script == name, F.concat(F.array_join(syllables, ""), pick(cs, F.lit(-1)), end)).otherwise(out)
    return out


def drawn(entities: DataFrame, secret: str, attempt: int) -> DataFrame:
    """`entities` (kind, norm, gender) with `surrogate`, itself a normal form. From ATTEMPTS on, the format is two characters longer with each attempt.

    What is used more than once is a column of its own, or it would be computed each time.
    """
    kind, norm, more = F.col("kind"), F.col("norm"), max(0, attempt - (ATTEMPTS - 1)) * 2
    wide = F.when(kind == "EMAIL", F.concat(F.lit("a" * more), norm)).when(kind == "IP", F.concat(norm, F.lit(".0" * more))).otherwise(F.concat(norm, F.lit("0" * more)))
    sized = entities.withColumn("_wide", wide)
    last = F.when(kind == "CARD", check_digit(F.col("_wide")) == F.substring("_wide", -1, 1)).otherwise(F.lit(False))
    checked = sized.withColumn("_valid", last)  # a number that passes Luhn's test is all but its last digit
    front = F.substring(F.col("_wide"), F.lit(1), F.length("_wide") - F.col("_valid").cast("int"))
    turned = permuted(secret, F.when(F.col("_valid"), "LUHN").otherwise(kind), front, F.lit(attempt))
    name = made_up(secret, norm, F.col("gender"), F.lit(attempt))
    found = checked.withColumn("_drawn", F.when(kind == "NAME", name).otherwise(turned))
    ended = F.concat("_drawn", check_digit(F.concat("_drawn", F.lit("0"))))
    return found.withColumn("surrogate", F.when(F.col("_valid"), ended).otherwise(F.col("_drawn"))).select(*entities.columns, "surrogate")


def surrogates(found: DataFrame, secret: str) -> DataFrame:
    """(kind, norm, surrogate) for each different entity of `found` (kind, norm, gender). Different entities of a kind get different ones, and none is an entity of that kind.

    A given name has the gender of the titles before it, none if they differ.
    """
    said = F.array_sort(F.collect_set(F.when(F.col("gender") != "n", F.col("gender"))))
    known = found.filter("kind is not null").groupBy("kind", "norm").agg(said.alias("said"))
    known = materialize(known.select("kind", "norm", F.when(F.size("said") == 1, F.get("said", 0)).otherwise("n").alias("gender")), "entities")
    real = known.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("taken"))
    left, done, attempt = known, None, 0
    while True:
        these = materialize(drawn(left, secret, attempt), "drawn")
        taken = real if done is None else real.unionAll(done.select("kind", "surrogate", F.lit(True).alias("taken")))
        nth = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("norm"))
        checked = these.withColumn("nth", nth).join(taken.distinct(), ["kind", "surrogate"], "left")
        checked = materialize(checked.select("kind", "norm", "gender", "surrogate", ((F.col("nth") > 1) | F.col("taken").isNotNull()).alias("bad")), "surrogates")
        good = checked.filter("not bad").select("kind", "norm", "surrogate")
        done = good if done is None else done.unionAll(good)
        left = checked.filter("bad").select("kind", "norm", "gender")
        discard(these)
        if not left.limit(1).count():
            return done
        attempt += 1


def _spelled(kind: Column, value: Column, norm: Column) -> Column:
    """The surrogate `norm` as the occurrence `value` is spelled."""
    upper = F.upper(value) == value
    name = F.when(upper, F.upper(norm)).otherwise(F.initcap(norm))
    cased = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(F.substring(value, i + 1, F.lit(1)).rlike("^[A-Z]$"), F.upper(c)).otherwise(c)), "")
    before = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[^0-9A-Z]", ""))
    filled = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("^[0-9A-Z]$"), F.substring(norm, before(i) + 1, F.lit(1))).otherwise(c)), "")
    rest = F.substring(norm, before(F.length(value)) + 1, F.length(norm))
    return F.when(kind == "NAME", name).when(kind.isin(*CASELESS), cased).when(kind.isin(*PARTED), F.concat(filled, rest)).otherwise(norm)


def _mentions(text: Column, names: Column) -> Column:
    """`text` with each word of `names` (norm, surrogate), spelled as a name or in capitals, replaced."""

    def one(acc: Column, n: Column) -> Column:
        for spell in (F.initcap, F.upper):
            pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}])\Q"), spell(n["norm"]), F.lit(r"\E(?![\p{L}\p{M}])"))
            acc = F.regexp_replace(acc, pattern, spell(n["surrogate"]))
        return acc

    return F.aggregate(names, text, one)


def anonymized(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_entities, text): a row per row of `docs`; each entity replaced by its surrogate. n_entities counts what the patterns find.

    Null texts stay null; texts without entities are unchanged and are not moved. Rows that share an id but not a text are kept apart.
    """
    found = materialize(entities(docs, id_col, text_col), "parts")
    mapped = found.join(surrogates(found, secret), ["kind", "norm"], "left")
    shown = F.when(F.col("surrogate").isNull(), F.col("value")).otherwise(_spelled(F.col("kind"), F.col("value"), F.col("surrogate")))
    named = F.when(F.col("kind") == "NAME", F.struct("norm", "surrogate"))
    mapped = materialize(mapped.select(*DOC, "m", "u", shown.alias("s"), named.alias("name")), "mapped")
    parts = F.array_sort(F.collect_list(F.struct("u", "s")))
    matches = mapped.groupBy(*DOC, "m").agg(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("s"), F.collect_list("name").alias("names"))
    listed = F.array_sort(F.collect_list(F.struct("m", "s")))
    per_doc = matches.groupBy(*DOC).agg(F.transform(listed, lambda p: p["s"]).alias("new"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    per_doc = materialize(per_doc, "replacements")
    discard(found)
    discard(mapped)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    some, rest = split_by_keys(rows, per_doc, DOC)
    n = per_doc.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "new", "names").hint("merge")
    joined = some.join(n, some.doc_id.eqNullSafe(n["_d"]) & (some.key == n["_k"]), "left")
    gap = lambda g: F.when(F.size("names") > 0, _mentions(g, F.col("names"))).otherwise(g)
    text = F.array_join(F.zip_with(F.split("text", PATTERN), F.col("new"), lambda g, s: F.concat(gap(g), F.coalesce(s, F.lit("")))), "")
    changed = joined.select("doc_id", F.coalesce(F.size("new"), F.lit(0)).alias("n_entities"), F.when(F.col("new").isNull(), F.col("text")).otherwise(text).alias("text"))
    return changed.unionAll(rest.select("doc_id", F.lit(0), "text"))
