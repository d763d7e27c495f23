"""Operators to put between a stream and its queries (`Engine.add_operator`): functions of event frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import order


def deduplicated(*columns: str) -> Callable[[DataFrame], DataFrame]:
    """Only the first event of each combination of values of `columns`; nulls are equal to each other.

    Of a streaming frame Spark's state store remembers the combinations seen; of a stored one, or a micro-batch of pushed events, only those in the frame count.
    """

    def operator(events: DataFrame) -> DataFrame:
        if events.isStreaming:
            return events.dropDuplicates(list(columns))
        first = F.min(F.struct(*order(events), F.struct("*").alias("__row"))).alias("__first")
        return events.groupBy(*columns).agg(first).select("__first.__row.*")

    return operator
