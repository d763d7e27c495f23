"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose remainder this is are held out from training.
HELD_OUT_REMAINDER = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: `spark.checkpoint.dir`, or where that is unset and all runs in one machine (tests) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="streamloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{checkpoint_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that `materialize` wrote and nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc.hadoopConfiguration()).delete(where, True)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def row_key(text: Column) -> Column:
    """Tells rows apart that share an id but not a text."""
    return F.xxhash64(text, F.length(text))


#: Bits of the map in which `split_by_keys` marks keys: 16 a key within these bounds, so at most 8 MB go to a task. Far beyond 10^8 keys the map rules out little, and the rows move.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26


def key_map(keys: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """(words of 64 bits, number of bits): bit pmod(xxhash64(columns), bits) is set for each key. Bounded by MOST_BITS, whatever the keys."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    bit = F.pmod(F.xxhash64(*columns), F.lit(bits))
    words = keys.select(bit.alias("b")).groupBy(F.expr("b div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("word")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out, bits


def split_by_keys(df: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may have their `columns` in `keys`, rows that surely have not), without moving a row of `df`."""
    words, bits = key_map(keys, columns)
    one = pa.table({"_map": pa.array([words], pa.list_(pa.int64()))})
    marked = df.crossJoin(F.broadcast(df.sparkSession.createDataFrame(one)))  # one row
    bit = F.pmod(F.xxhash64(*columns), F.lit(bits))
    word = F.get(F.col("_map"), F.shiftright(bit, 6).cast("int"))
    found = F.getbit(word, F.pmod(bit, F.lit(64)).cast("int")) == 1
    return marked.filter(found).drop("_map"), marked.filter(~found).drop("_map")


def without_keys(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, all columns, without the rows whose (doc_id, key) is in `keys`. `keys` may have a column `one`: where it is true, one row of the equal ones stays. Rows that are surely not meant do not move."""
    names = docs.columns
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("key"))
    some, rest = split_by_keys(rows, keys, ["doc_id", "key"])
    one = F.col("one") if "one" in keys.columns else F.lit(False)
    k = keys.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.max(one).alias("_one")).hint("merge")
    # not an anti join: the optimizer would take that below the map's filter, and move all rows
    found = some.join(k, some.doc_id.eqNullSafe(k["_d"]) & (some.key == k["_k"]), "left")
    stay = found.filter("_k is null").select("row")
    if "one" in keys.columns:
        stay = stay.unionAll(found.filter("_one").dropDuplicates(["doc_id", "key"]).select("row"))
    return stay.unionAll(rest.select("row")).select(*(F.col("row").getField(c).alias(c) for c in names))
