"""Joins of two streams within a window, and of a stream with a reference table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import ARRIVAL, TIE, order, own, span

#: Reference tables up to so many bytes (of their values, and 16 for each) are broadcast; they are counted, not guessed.
BROADCAST_BYTES = 64 << 20


def _keys(left: DataFrame, right: DataFrame, a: str, b: str, op: str) -> Column:
    x, y = left[f"__l_{a}"], right[f"__r_{b}"]
    return x == y if op == "=" else x != y


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"__{side}_{c}") for c in own(df)), *(F.col(c).alias(f"__{side}{c}") for c in order(df)))


def _merged(joined: DataFrame, left: list[str], right: list[str], prefix: str, *more: Column) -> DataFrame:
    """All columns of both sides; a name that both have gets the prefix on the right."""
    names = [F.col(f"`__l_{c}`").alias(c) for c in left]
    names += [F.col(f"`__r_{c}`").alias(f"{prefix}{c}" if c in left else c) for c in right]
    return joined.select(*names, *more)


def _ties(left: DataFrame, right: DataFrame) -> list[Column]:
    """Pairs of one instant keep the order of their left events, then of their right ones."""
    both = [f"__l{c}" for c in order(left)] + [f"__r{c}" for c in order(right)]
    return [F.col(c).alias(f"{TIE}{k}") for k, c in enumerate(both)]


def _has(df: DataFrame, column: str) -> bool:
    return column in own(df)


def _nothing(left: DataFrame, right: DataFrame, prefix: str) -> DataFrame:
    """A side that does not declare the join column never matches."""
    none = _sided(left, "l").crossJoin(_sided(right, "r")).filter(F.lit(False))
    return _merged(none, own(left), own(right), prefix, F.col(f"__l{ARRIVAL}").alias(ARRIVAL), *_ties(left, right))


def tumbling_join(left: DataFrame, right: DataFrame, a: str, op: str, b: str, micros: int, flush_last: bool = False, prefix: str = "right_", first_event: int | None = None) -> DataFrame:
    """Pairs of events of one window, given out when the window closes: at the arrival of the first event after it.

    Windows follow the first event of either stream. The bucket is an equi-join key, so `!=` joins are local to a window as well. Column ARRIVAL is the time of giving out.
    """
    if not (_has(left, a) and _has(right, b)):
        return _nothing(left, right, prefix)
    both = left.select(ARRIVAL).unionAll(right.select(ARRIVAL))
    start = F.col("__first") if first_event is None else F.lit(first_event)
    first = F.broadcast(span(both).select(start.alias("__t0")))  # one row
    bucket = lambda c: F.floor((F.col(c) - F.col("__t0")) / micros)
    closes = both.crossJoin(first).groupBy(bucket(ARRIVAL).alias("__w")).agg(F.min(ARRIVAL).alias("__begin"))
    closes = closes.select("__w", F.lead("__begin").over(Window.orderBy("__w")).alias("__close"))
    l = _sided(left, "l").crossJoin(first).withColumn("__wl", bucket(f"__l{ARRIVAL}")).drop("__t0")
    r = _sided(right, "r").crossJoin(first).withColumn("__wr", bucket(f"__r{ARRIVAL}")).drop("__t0")
    joined = l.join(r, (F.col("__wl") == F.col("__wr")) & _keys(l, r, a, b, op)).join(closes, F.col("__wl") == F.col("__w"))
    if not flush_last:
        joined = joined.filter("__close is not null")
    at = F.coalesce("__close", F.greatest(f"__l{ARRIVAL}", f"__r{ARRIVAL}")).alias(ARRIVAL)
    return _merged(joined, own(left), own(right), prefix, at, *_ties(left, right))


def sliding_join(left: DataFrame, right: DataFrame, a: str, op: str, b: str, micros: int, prefix: str = "right_") -> DataFrame:
    """Pairs of events at most the window's size apart, given out when the later one arrives.

    Time is cut into steps of the window's size, and each right event is put in its own and both neighbouring steps: the step is an equi-join key for `=` and `!=` alike.
    """
    if not (_has(left, a) and _has(right, b)):
        return _nothing(left, right, prefix)
    step = lambda c: F.floor(F.col(c) / micros)
    l = _sided(left, "l").withColumn("__wl", step(f"__l{ARRIVAL}"))
    near = F.array(*(step(f"__r{ARRIVAL}") + k for k in (-1, 0, 1)))
    r = _sided(right, "r").withColumn("__wr", F.explode(near))
    within = F.abs(F.col(f"__l{ARRIVAL}") - F.col(f"__r{ARRIVAL}")) <= micros
    joined = l.join(r, (F.col("__wl") == F.col("__wr")) & within & _keys(l, r, a, b, op))
    at = F.greatest(f"__l{ARRIVAL}", f"__r{ARRIVAL}").alias(ARRIVAL)
    return _merged(joined, own(left), own(right), prefix, at, *_ties(left, right))


def _bytes(table: DataFrame) -> int:
    """Of all values, written out."""
    each = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in table.columns]
    return table.agg(F.sum(sum(each, F.lit(0)).cast("long"))).first()[0] or 0


def table_join(stream: DataFrame, table: DataFrame, a: str, op: str, b: str, prefix: str = "table_", small: bool | None = None) -> DataFrame:
    """Each event with each row of the table that matches; the event's column is compared as the table's type. Null matches nothing.

    A table of BROADCAST_BYTES at most is broadcast. A larger one is joined by shuffles: for `=` on the column, for `!=` in parts of that size, each of which
    meets all events. The result of a `!=` join has nearly events times rows, whatever the plan.
    """
    kept = [c for c in stream.columns if c.startswith("__")]
    if a not in own(stream) or b not in table.columns:
        none = stream.crossJoin(table.limit(0).select(*(F.col(f"`{c}`").alias(f"__r_{c}") for c in table.columns)))
        names = [F.col(f"`{c}`") for c in own(stream)] + [F.col(f"`__r_{c}`").alias(f"{prefix}{c}" if c in own(stream) else c) for c in table.columns]
        return none.select(*names, *kept)
    size = 0 if small else _bytes(table)
    small = size <= BROADCAST_BYTES if small is None else small
    right = table.select(*(F.col(f"`{c}`").alias(f"__r_{c}") for c in table.columns))
    key = F.col(f"`{a}`").try_cast(table.schema[b].dataType)
    other = F.col(f"`__r_{b}`")
    if small:
        joined = stream.join(F.broadcast(right), key == other if op == "=" else key != other)
    elif op == "=":
        joined = stream.join(right, key == other)
    else:
        parts = max(2, -(-size // BROADCAST_BYTES))
        left = stream.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
        right = right.withColumn("__r_part", F.pmod(F.xxhash64(*right.columns), F.lit(parts)))
        joined = left.join(right, (F.col("__part") == F.col("__r_part")) & (key != other)).drop("__part", "__r_part")
    names = [F.col(f"`{c}`") for c in own(stream)]
    names += [F.col(f"`__r_{c}`").alias(f"{prefix}{c}" if c in own(stream) else c) for c in table.columns]
    return joined.select(*names, *kept)
