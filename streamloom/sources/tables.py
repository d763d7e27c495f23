"""Reference tables: typed tables that can be changed row by row, kept as Parquet versions behind a pointer.

Each change writes a new version (an insert only new files, which the version lists with the old ones) and then swaps the pointer in one rename,
so a reader sees the table before or after a change. A join that opens the table anew for each micro-batch sees all changes made before.
"""

from __future__ import annotations

import json
import re
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import TABLE_TYPES, declared

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class TableError(ValueError):
    """A table operation that cannot be done."""


def checked(name: str) -> str:
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise TableError(f"{name!r} is not a name")
    return name


class ReferenceTables:
    """The tables below one folder, which all drivers and executors can reach."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def _read(self, table: str) -> dict[str, Any]:
        path = self.root / checked(table) / "current.json"
        if not path.exists():
            raise TableError(f"no table is named {table!r}")
        return json.loads(path.read_text())

    def _swap(self, table: str, columns: list[list[str]], parts: list[str]) -> None:
        where = self.root / table
        where.mkdir(parents=True, exist_ok=True)
        new = where / f"current-{uuid.uuid4().hex}"
        new.write_text(json.dumps({"columns": columns, "parts": parts}))
        new.replace(where / "current.json")

    @staticmethod
    def _schema(columns: list[list[str]]) -> T.StructType:
        return T.StructType([T.StructField(n, TABLE_TYPES.get(k.upper(), T.StringType())) for n, k in columns])

    def _write(self, table: str, df: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        df.write.parquet(str(self.root / table / part))
        return part

    def create_table(self, table: str, columns: list[tuple[str, str]]) -> None:
        """Does nothing if the table exists. Types that are not known are STRING."""
        checked(table)
        if not columns:
            raise TableError("a table has at least one column")
        names = [checked(n) for n, _ in columns]
        if len(set(names)) < len(names):
            raise TableError("two columns have one name")
        if not (self.root / table / "current.json").exists():
            self._swap(table, [[n, k] for n, k in columns], [])

    def from_rows(self, table: str, columns: list[tuple[str, str]], rows: list[dict[str, Any]]) -> None:
        """Drop a table, if there, and make it anew from rows."""
        self.create_table(table, columns)
        self._swap(table, [[n, k] for n, k in columns], [])
        if rows:
            self.insert_rows(table, rows)

    def frame(self, table: str) -> DataFrame:
        """The rows as they are now. Columns that were added later are null in older files."""
        now = self._read(table)
        schema = self._schema(now["columns"])
        if not now["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(str(self.root / table / p) for p in now["parts"]))

    def add_column(self, table: str, column: str, kind: str) -> None:
        """Old rows have null there: nothing is written but the pointer."""
        now = self._read(table)
        if any(n == checked(column) for n, _ in now["columns"]):
            raise TableError(f"{table!r} has a column {column!r}")
        self._swap(table, [*now["columns"], [column, kind]], now["parts"])

    def _fitted(self, schema: T.StructType, row: dict[str, Any]) -> tuple:
        unknown = set(row) - set(schema.names)
        if unknown:
            raise TableError(f"no column is named {', '.join(sorted(unknown))}")
        to = {T.LongType: int, T.DoubleType: float, T.StringType: str, T.BooleanType: bool}
        return tuple(None if row.get(f.name) is None else to[type(f.dataType)](row[f.name]) for f in schema)

    def insert_row(self, table: str, row: dict[str, Any]) -> None:
        self.insert_rows(table, [row])

    def insert_rows(self, table: str, rows: list[dict[str, Any]]) -> None:
        if not rows or any(not r for r in rows):
            raise TableError("there is nothing to insert")
        now = self._read(table)
        schema = self._schema(now["columns"])
        part = self._write(table, self.spark.createDataFrame([self._fitted(schema, r) for r in rows], schema).coalesce(1))
        self._swap(table, now["columns"], [*now["parts"], part])

    def append(self, table: str, df: DataFrame) -> None:
        """All rows of `df`, its columns by name."""
        now = self._read(table)
        schema = self._schema(now["columns"])
        cols = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        self._swap(table, now["columns"], [*now["parts"], self._write(table, df.select(*cols))])

    def _matches(self, df: DataFrame, where: dict[str, Any]) -> Column:
        out = F.lit(True)
        for name, value in where.items():
            if name not in df.columns:
                raise TableError(f"no column is named {name}")
            out = out & (F.lit(False) if value is None else F.col(f"`{name}`") == F.lit(value).cast(df.schema[name].dataType))
        return F.coalesce(out, F.lit(False))

    def update_rows(self, table: str, values: dict[str, Any], where: dict[str, Any]) -> int:
        """The number of rows changed: those equal to `where` in all its columns; null equals nothing."""
        if not values or not where:
            raise TableError("an update needs values and conditions")
        df = self.frame(table)
        hit = self._matches(df, where)
        self._fitted(df.schema, values)
        n = df.filter(hit).count()
        new = [F.when(hit, F.lit(values[f.name]).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in values else F.col(f"`{f.name}`") for f in df.schema]
        self._swap(table, self._read(table)["columns"], [self._write(table, df.select(*new))])
        return n

    def delete_rows(self, table: str, where: dict[str, Any]) -> int:
        if not where:
            raise TableError("a deletion needs conditions")
        df = self.frame(table)
        hit = self._matches(df, where)
        n = df.filter(hit).count()
        self._swap(table, self._read(table)["columns"], [self._write(table, df.filter(~hit))])
        return n

    def list_tables(self) -> list[str]:
        return sorted(p.parent.name for p in self.root.glob("*/current.json"))

    def table_schema(self, table: str) -> list[tuple[str, str]]:
        return [(n, k) for n, k in self._read(table)["columns"]]

    def declared_schema(self, table: str) -> dict[str, str]:
        return {f.name: declared(f.dataType) for f in self._schema(self._read(table)["columns"])}

    def select_rows(self, table: str, limit: int = 20) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.frame(table).limit(limit).collect()]


class SessionTables:
    """Tables that live as long as the session, and SQL over them."""

    def __init__(self, spark: SparkSession):
        self.spark, self._schemas, self._frames = spark, {}, {}

    def create_table(self, table: str, columns: dict[str, str]) -> None:
        schema = T.StructType([T.StructField(checked(n), TABLE_TYPES.get(k.upper(), T.StringType())) for n, k in columns.items()])
        self._schemas[checked(table)] = schema
        self._set(table, self.spark.createDataFrame([], schema))

    def _set(self, table: str, df: DataFrame) -> None:
        self._frames[table] = df
        df.createOrReplaceTempView(table)

    def insert(self, table: str, row: dict[str, Any]) -> None:
        self.insert_batch(table, [row])

    def insert_batch(self, table: str, rows: list[dict[str, Any]]) -> None:
        """The first row says which columns there are."""
        if not rows:
            return
        schema = self._schemas[table]
        to = {T.LongType: int, T.DoubleType: float, T.StringType: str, T.BooleanType: bool}
        names = set(rows[0])
        fit = [tuple(None if f.name not in names or r.get(f.name) is None else to[type(f.dataType)](r[f.name]) for f in schema) for r in rows]
        self._set(table, self._frames[table].unionAll(self.spark.createDataFrame(fit, schema)))

    def query(self, sql: str) -> DataFrame:
        """Spark SQL; `.toPandas()` gives a pandas frame."""
        return self.spark.sql(sql)

    def close(self) -> None:
        for t in self._frames:
            self.spark.catalog.dropTempView(t)
        self._frames.clear()
