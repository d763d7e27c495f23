"""Filters and projections."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import is_number
from ..plans.query import Condition, QueryError

COMPARE = {">": operator.gt, "<": operator.lt, "=": operator.eq, ">=": operator.ge, "<=": operator.le, "!=": operator.ne}


def compared(df: DataFrame, column: Column, kind: T.DataType, op: str, value: int | float | str) -> Column:
    """The comparison, by declared types: across types nothing is equal, all is different, and nothing is larger or smaller."""
    if op not in COMPARE:
        raise QueryError(f"unknown operator {op!r}")
    if isinstance(kind, T.BooleanType):
        column, kind = column.cast("int"), T.IntegerType()
    if isinstance(value, str) != isinstance(kind, T.StringType) or not (is_number(kind) or isinstance(kind, T.StringType)):
        return column.isNotNull() if op == "!=" else F.lit(False)
    return COMPARE[op](column, F.lit(value))


def filtered(df: DataFrame, condition: Condition) -> DataFrame:
    """Rows that pass; a row without the column, or with null in it, does not, and a column that is not declared is in no row."""
    if condition.field not in df.columns:
        return df.filter(F.lit(False))
    column = F.col(f"`{condition.field}`")
    return df.filter(compared(df, column, df.schema[condition.field].dataType, condition.op, condition.value))


def projected(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The named columns in order, each once; a column that is not declared is null (and left out where rows become JSON)."""
    missing = lambda c: F.lit(None).cast("string").alias(c)
    wanted = [F.col(f"`{c}`") if c in df.columns else missing(c) for c in dict.fromkeys(columns)]
    return df.select(*wanted, *(c for c in keep if c in df.columns))
