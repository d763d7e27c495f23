"""Declared types, and the schemas that queries give."""

from __future__ import annotations

from pyspark.sql import types as T

#: Types of stream columns. A timestamp stays the text that the event carried.
STREAM_TYPES: dict[str, T.DataType] = {
    "INT": T.LongType(),
    "FLOAT": T.DoubleType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.StringType(),
}
#: What else a reference table may name.
TABLE_TYPES = STREAM_TYPES | {"TEXT": T.StringType(), "INTEGER": T.LongType(), "REAL": T.DoubleType()}


def struct(columns: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, STREAM_TYPES.get(kind.upper(), T.StringType())) for name, kind in columns.items()])


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def declared(kind: T.DataType) -> str:
    """The declared name of a Spark type."""
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, T.IntegralType):
        return "INT"
    if isinstance(kind, T.NumericType):
        return "FLOAT"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "TIMESTAMP"
    return "STRING"


def merged(left: dict[str, str], right: dict[str, str], prefix: str) -> dict[str, str]:
    """Columns of a join: the left side wins a name, the right side's column takes the prefix."""
    return left | {(f"{prefix}{name}" if name in left else name): kind for name, kind in right.items()}


def infer_output_schema(plan, left: dict[str, str], right: dict[str, str] | None = None, prefix: str = "right_") -> dict[str, str]:
    """The declared output columns of a query: counts are INT, other aggregates FLOAT, unknown columns STRING."""
    known = merged(left, right, prefix) if right else dict(left)
    if plan.star:
        return known
    out = {}
    for item in plan.select:
        out[item.name] = ("INT" if item.func == "COUNT" else "FLOAT") if item.func else known.get(item.field, "STRING")
    return out
