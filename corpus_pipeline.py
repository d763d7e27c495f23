"""The corpus pipeline: documents without the toxic, near-duplicate and contaminated ones, mixed to weights, as token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm import decontam, mixing, neardup, queries, tokenids, toxicity
from streamloom.llm.common import materialize, table

#: Fewer than op8 alone remembers: the workers still hold memory of the stages before.
CACHE_WORDS = 150_000

#: SQL cannot express training, fingerprints or token files: the tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.nontoxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs, queries.domain_of(F.col("source")), queries.WEIGHTS, *queries.BUDGET, queries.EPOCHS, queries.SEED)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, rows = tokenids.written_tokens(docs, queries.word_tokens(cache_words=CACHE_WORDS), queries.END_ID, queries.MOST_ID)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token ids", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage works on what the one before it kept, written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
