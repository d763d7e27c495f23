"""Connected components by alternating large-star and small-star steps, with DataFrame operations only.

Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii: Connected Components in MapReduce and Beyond (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(
        edges.select(F.col("v").alias("n"), F.col("u").alias("m"))
    )
    least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
    return (
        both.filter("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("least").alias("v")).filter("u != v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Expects u > v in each row."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    hooked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u != v")
    return hooked.unionAll(least.select("u", F.col("least").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component) for each node that a link touches; component is the least node reachable.

    Loops and repeated links change nothing; rows with a null end are ignored; no links give an empty result.
    Each step is an aggregation and a join on a node with partial sums on the map side, so that a node with very
    many links is dealt with by the skew-join rule; nothing goes to the driver but one count and one checksum.
    """
    edges = materialize(
        links.select(
            F.greatest(left, right).alias("u"), F.least(left, right).alias("v"), (F.col(left).isNull() | F.col(right).isNull()).alias("gap")
        )
        .filter("not gap and u != v")
        .select("u", "v")
        .distinct(),
        "edges",
    )
    before = _signature(edges)
    while before[0]:
        after = materialize(_small_star(_large_star(edges)), "edges")
        now = _signature(after)
        discard(edges)
        edges = after
        if now == before:
            break
        before = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
