"""Grouped and global COUNT, SUM, AVG, MAX and MIN, per emission or running on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.query import Item, QueryError, Select
from .frames import EMIT, order


def _value(df: DataFrame, item: Item, exact_scale: int | None) -> Column:
    if item.field not in df.columns:
        return F.lit(None).cast("double")
    kind, column = df.schema[item.field].dataType, F.col(f"`{item.field}`")
    if item.func in ("SUM", "AVG"):
        if isinstance(kind, T.BooleanType):
            return column.cast("long")
        if not isinstance(kind, T.NumericType):
            raise QueryError(f"{item.func} of {item.field}, which is no number")
        if isinstance(kind, (T.DoubleType, T.FloatType)) and exact_scale is not None:
            return column.cast(T.DecimalType(18, exact_scale))
    return column


def _bare(plan: Select) -> list[str]:
    return list(dict.fromkeys(i.field for i in plan.select if not i.func and i.field not in plan.keys))


def partials(df: DataFrame, plan: Select, exact_scale: int | None = None) -> DataFrame:
    """Per emission and group: __k (keys), __c and __v (count and value of each aggregate), __b (first value of each bare column, with its place)."""
    emit = [EMIT] if EMIT in df.columns else []
    known = df.select("*", *(F.lit(None).cast("string").alias(k) for k in plan.keys if k not in df.columns))
    parts: dict[str, Column] = {}
    for k, i in enumerate(plan.aggregates):
        v = _value(known, i, exact_scale)
        parts[f"__c{k}"] = F.count(v)
        if i.func != "COUNT":
            parts[f"__v{k}"] = {"MAX": F.max, "MIN": F.min}.get(i.func, F.sum)(v)
    for k, field in enumerate(_bare(plan)):
        column = F.col(f"`{field}`") if field in known.columns else F.lit(None).cast("string")
        parts[f"__b{k}"] = F.min(F.struct(*order(df), column.alias("__value")))
    group = [F.col(f"`{k}`").alias(f"__k{n}") for n, k in enumerate(plan.keys)]
    return known.groupBy(*emit, *group).agg(*(c.alias(name) for name, c in parts.items()))


def _merge(plan: Select) -> dict[str, Column]:
    out = {f"__c{k}": F.sum(f"__c{k}") for k in range(len(plan.aggregates))}
    for k, i in enumerate(plan.aggregates):
        if i.func != "COUNT":
            out[f"__v{k}"] = {"MAX": F.max, "MIN": F.min}.get(i.func, F.sum)(f"__v{k}")
    return out


def merged(parts: DataFrame, plan: Select, *by: str) -> DataFrame:
    """Partials of one group (and of one value of `by`) made one."""
    first = {f"__b{k}": F.min(f"__b{k}") for k in range(len(_bare(plan)))}
    out = parts.groupBy(*by, *(f"__k{n}" for n in range(len(plan.keys)))).agg(*(c.alias(name) for name, c in (_merge(plan) | first).items()))
    return out.select(*(F.col(c).cast(parts.schema[c].dataType) if c.startswith(("__c", "__v")) else F.col(c) for c in parts.columns if c in out.columns))


def running(parts: DataFrame, plan: Select) -> DataFrame:
    """Counts and values of a group over all its emissions so far."""
    run = Window.partitionBy(*([f"__k{n}" for n in range(len(plan.keys))] or [F.lit(0)])).orderBy(EMIT).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumns({name: c.over(run) for name, c in _merge(plan).items()})


def finished(parts: DataFrame, plan: Select, keep: bool = False) -> DataFrame:
    """Partials to rows, in the order of SELECT. Groups without any value to aggregate give no row."""
    found = parts.filter(reduce(lambda a, b: a | b, (F.col(f"__c{k}") > 0 for k in range(len(plan.aggregates)))))
    values: dict[str, Column] = {k: F.col(f"__k{n}") for n, k in enumerate(plan.keys)}
    values |= {b: F.col(f"__b{k}").getField("__value") for k, b in enumerate(_bare(plan))}
    for k, i in enumerate(plan.aggregates):
        c, v = F.col(f"__c{k}"), F.col(f"__v{k}")
        if i.func == "COUNT":
            values[i.name] = c.cast("long")
        elif i.func == "AVG":
            values[i.name] = v.cast("double") / F.when(c > 0, c).cast("double")
        elif i.func == "SUM":
            values[i.name] = v if isinstance(parts.schema[f"__v{k}"].dataType, T.LongType) else v.cast("double")
        else:
            values[i.name] = v
    return found.select(*(values[i.name].alias(i.name) for i in dict.fromkeys(plan.select)), *([EMIT] if keep and EMIT in parts.columns else []))


def aggregated(df: DataFrame, plan: Select, cumulative: bool, exact_scale: int | None = None, keep: bool = False) -> DataFrame:
    """The rows of each emission of `df`: one per group in it; without a column EMIT all of `df` is one emission.

    A bare column that is no grouping column has the value of the group's first event of the emission. `cumulative` merges each emission into all earlier ones
    of its group. `exact_scale` adds floats up as decimals of that scale, which makes sums independent of their order. `keep` keeps EMIT.
    """
    parts = partials(df, plan, exact_scale)
    return finished(running(parts, plan) if cumulative and EMIT in parts.columns else parts, plan, keep)
