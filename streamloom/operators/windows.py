"""Windows and when they fire: from event frames to emissions.

An emission frame has a row for each event and each emission that it is part of; EMIT tells the emissions of a query apart, in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.deployment import Windowing
from .frames import ARRIVAL, EMIT, SEQ, WINDOW, span

_FULL = (1 << 62) - 1


def bucketed(df: DataFrame, micros: int, first_event: int | None = None) -> DataFrame:
    """`df` with WINDOW: the number of its tumbling window, counted from the first event of all or the one given."""
    if first_event is not None:
        return df.withColumn(WINDOW, F.floor((F.col(ARRIVAL) - F.lit(first_event)) / micros))
    first = F.broadcast(span(df).select(F.col("__first").alias("__t0")))  # one row
    return df.crossJoin(first).withColumn(WINDOW, F.floor((F.col(ARRIVAL) - F.col("__t0")) / micros)).drop("__t0")


def _closed(df: DataFrame) -> DataFrame:
    """Without the last window, which nothing has closed yet."""
    last = F.broadcast(df.agg(F.max(WINDOW).alias("__wmax")))  # one row
    return df.crossJoin(last).filter(F.col(WINDOW) < F.col("__wmax")).drop("__wmax")


def _scan(micros: int, since: int | None = None):
    """Rows (window, arrival, seq) in order: those that come `micros` or more after the last that fired. State is one number, so a stream of any length passes through; `since` is where it begins, or else the first row does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = last = None
        for b in batches:
            ws, at, seq = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            fired = []
            edges = [0, *(np.nonzero(np.diff(ws))[0] + 1).tolist(), len(ws)]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                if ws[a] != window:
                    window, last = ws[a], at[a] if since is None else since
                k = a + int(np.searchsorted(at[a:z], last + micros))
                while k < z:
                    fired.append(k)
                    last = at[k]
                    k = a + int(np.searchsorted(at[a:z], last + micros))
            yield pa.RecordBatch.from_arrays([pa.array(ws[fired], pa.int64()), pa.array(at[fired], pa.int64()), pa.array(seq[fired], pa.int64())], ["w", "a", "s"])

    return run


def triggers(df: DataFrame, w: Windowing, window: str | None = None, since: int | None = None) -> DataFrame:
    """(w, a, s): window, arrival and order of the events at which the velocity fires; counters start anew in each `window`, if one is named."""
    of = F.col(window) if window else F.lit(0).cast("long")
    if w.velocity_type.lower() == "count":
        n = int(w.velocity)
        if n < 1:
            raise ValueError("a count velocity is at least 1")
        nth = F.row_number().over(Window.partitionBy(window).orderBy(SEQ)) if window else F.col(SEQ)
        return df.withColumn("__nth", nth).filter(F.col("__nth") % n == 0).select(of.cast("long").alias("w"), F.col(ARRIVAL).alias("a"), F.col(SEQ).alias("s"))
    times = df.select(of.cast("long").alias("w"), F.col(ARRIVAL).alias("a"), F.col(SEQ).alias("s"))
    # each firing depends on the one before: one task, but of two numbers a row, streamed in order
    return times.repartition(1).sortWithinPartitions("w", "s").mapInArrow(_scan(round(w.velocity * 1_000_000), since), "w long, a long, s long")


def _whole(closed: DataFrame) -> DataFrame:
    return closed.withColumn(EMIT, F.struct(F.col(WINDOW).alias("w"), F.lit(_FULL).alias("s")))


def early(held: DataFrame, closed: DataFrame, w: Windowing, after: int = 0) -> DataFrame:
    """Each window of `closed`, and what a window of `held` holds whenever the velocity fires in it, at events whose order is over `after`."""
    t = triggers(held, w, WINDOW).filter(F.col("s") > after)
    firings = held.join(t, (held[WINDOW] == t.w) & (held[SEQ] <= t.s)).withColumn(EMIT, F.struct("w", "s")).drop("w", "a", "s")
    return _whole(closed).unionByName(firings).drop(WINDOW)


def tumbling(df: DataFrame, w: Windowing) -> DataFrame:
    """Each closed window is an emission; with tumbling_velocity also what a window holds whenever the velocity fires in it."""
    windows = bucketed(df, w.micros)
    closed = windows if w.flush_last else _closed(windows)
    return early(windows, closed, w) if w.tumbling_velocity else _whole(closed).drop(WINDOW)


def sliding(df: DataFrame, w: Windowing, fired: DataFrame | None = None) -> DataFrame:
    """Whenever the velocity fires: the events of the last `size`, its first instant included.

    Time is cut into steps of the window's size; a firing looks at its own step and the one before, so step is an equi-join key.
    """
    step = lambda c: F.floor(F.col(c) / w.micros)
    fired = (triggers(df, w) if fired is None else fired).select("a", "s", F.explode(F.array(step("a") - 1, step("a"))).alias("__step"))
    held = df.withColumn("__step", step(ARRIVAL))
    joined = held.join(fired, "__step").filter((F.col(SEQ) <= F.col("s")) & (F.col(ARRIVAL) >= F.col("a") - w.micros))
    return joined.withColumn(EMIT, F.struct(F.lit(0).cast("long").alias("w"), "s")).drop("__step", "a", "s")


def emissions(df: DataFrame, w: Windowing) -> DataFrame:
    return sliding(df, w) if w.sliding else tumbling(df, w)
