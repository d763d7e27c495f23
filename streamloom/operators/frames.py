"""Event frames: DataFrames of events with the columns that say when and in which order they came.

ARRIVAL is the arrival time in microseconds; columns that begin with TIE order events of one instant. SEQ, the order of arrival from 1, is only made
where a query needs it. Names with two underscores are ours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ARRIVAL = "__arrival"
SEQ = "__seq"
TIE = "__tie"
EMIT = "__emit"
WINDOW = "__window"
#: Steps of time over which the order of arrival is counted.
STEPS = 4096


def own(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]


def span(df: DataFrame) -> DataFrame:
    """One row: the first and the last arrival."""
    return df.agg(F.min(ARRIVAL).alias("__first"), F.max(ARRIVAL).alias("__last"))


def order(df: DataFrame) -> list[str]:
    """The columns that put events in order of arrival."""
    return [ARRIVAL, *(c for c in df.columns if c.startswith(TIE))]


def sequenced(df: DataFrame) -> DataFrame:
    """`df` with SEQ by `order`, without bringing all rows together.

    Time is cut into STEPS steps; what came before a step is summed over the steps, and rows are numbered within their step.
    """
    stepped = df.crossJoin(F.broadcast(span(df)))  # one row
    width = F.greatest(F.expr("(__last - __first) div %d + 1" % STEPS), F.lit(1))
    stepped = stepped.withColumn("__step", F.floor((F.col(ARRIVAL) - F.col("__first")) / width)).drop("__first", "__last")
    counts = stepped.groupBy("__step").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__step", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__step").orderBy(*order(df)))
    return stepped.join(F.broadcast(before), "__step").withColumn(SEQ, (F.col("__before") + nth).cast("long")).drop("__step", "__before")  # STEPS rows at most


def events(df: DataFrame, time: str, *ties: str) -> DataFrame:
    """An event frame from a table with a time column."""
    return df.withColumns({ARRIVAL: F.unix_micros(F.col(time).cast("timestamp"))} | {f"{TIE}{k}": F.col(c) for k, c in enumerate(ties)})
