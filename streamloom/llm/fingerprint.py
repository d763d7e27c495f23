"""Document fingerprints: canonical exact digests, and their check by byte comparison.

The canonical form of a text is Unicode NFKC, case-folded, normalised again, with white space folded to single spaces. Its digest is the
128-bit XXH3 of its UTF-8 bytes. Documents with equal digests are compared byte by byte; should different canonical texts ever
meet in one digest, each gets a number of its own, so equal fingerprints always mean equal canonical texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, row_key, split_by_keys

BATCH_ROWS = 256


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)


def _digest_batches(keep: bool):
    """With `keep`, the compressed canonical bytes too: equal if and only if the canonical bytes are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in _slices(batches):
            canons = [canonical(t or "") for t in b.column(2).to_pylist()]
            columns = [b.column(0), b.column(1), pa.array([digest(c) for c in canons])]
            names = ["doc_id", "key", "digest"]
            if keep:
                columns.append(pa.array([pack(c) for c in canons], pa.binary()))
                names.append("canon")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))


def collisions(docs: DataFrame, digests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """(doc_id, key, nth) of rows whose digest also belongs to other canonical bytes; None if there are none.

    `digests` has doc_id, key and digest, a row per row of `docs`. Digests are grouped first; only texts in buckets of two rows or more are canonicalised again and
    move, as the least and greatest bytes of each bucket in a task, so a bucket with a third of all rows costs two values a task. Edited texts are
    compared with their own document's only.
    """
    shared = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    shared = materialize(shared, "shared")
    # the map lets a few others through, which are alone in their buckets below
    keys = materialize(split_by_keys(digests.select("doc_id", "key", "digest"), shared, ["digest"])[0].select("doc_id", "key"), "keys")
    discard(shared)
    some = split_by_keys(_rows(docs, id_col, text_col), keys, ["doc_id", "key"])[0]
    canons = some.mapInArrow(_digest_batches(True), "doc_id long, key long, digest string, canon binary")
    mixed = canons.groupBy("digest").agg(F.min("canon").alias("a"), F.max("canon").alias("z")).filter("a != z").select("digest")
    mixed = materialize(mixed, "mixed")
    discard(keys)
    if not mixed.limit(1).count():
        return None
    rows = canons.join(mixed, "digest", "left_semi")
    forms = rows.select("digest", "canon").distinct()
    forms = forms.withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy("canon")))
    return materialize(rows.join(forms, ["digest", "canon"]).select("doc_id", "key", "nth").distinct(), "collisions")


def _numbered(digests: DataFrame, clash: DataFrame | None, column: str = "digest") -> DataFrame:
    if clash is None:
        return digests
    c = clash.select(F.col("doc_id").alias("_i"), F.col("key").alias("_k"), "nth")
    joined = digests.join(c, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("key") == F.col("_k")), "left")
    return joined.withColumn(column, F.concat_ws("-", column, F.col("nth").cast("string"))).drop("_i", "_k", "nth")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fingerprint): a row per row of `docs`; null texts are empty; equal fingerprints if and only if equal canonical bytes."""
    digests = materialize(_rows(docs, id_col, text_col).mapInArrow(_digest_batches(False), "doc_id long, key long, digest string"), "digests")
    return _numbered(digests, collisions(docs, digests, id_col, text_col)).withColumnRenamed("digest", "fingerprint")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fingerprint, first_id): the least id of all rows with that canonical text."""
    found = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    first = found.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    return found.join(first, "fingerprint").select("doc_id", "key", "fingerprint", "first_id")


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in _slices(batches):
        z = pa.array([pack((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "key", "shard", "extra")), z], ["doc_id", "key", "shard", "extra", "z"])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a shard, each seen together with the row after it; extra rows only serve as such."""
    unpack, held, out = zstandard.ZstdDecompressor().decompress, None, []
    names = ["doc_id", "key", "n_chars", "edited_sha256", "digest", "edited_digest", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def finish() -> pa.RecordBatch:
        done = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
        out.clear()
        return pa.RecordBatch.from_arrays(done, names)

    ended = False
    for b in batches:
        for doc_id, key, extra, z in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "extra", "z"))):
            if ended:
                continue
            text = unpack(z).decode()
            canon = canonical(text)
            found = digest(canon)
            if held:
                i, k, t, c, d = held
                half = len(t) // 2
                edited = t[: len(t) - half] + text[:half]
                other = canonical(edited)
                out.append((i, k, len(t), hashlib.sha256(edited.encode()).hexdigest(), d, digest(other), float(c == other), float(c == canon)))
            held, ended = (doc_id, key, text, canon, found), extra
        if len(out) >= BATCH_ROWS:
            yield finish()
    if out:
        yield finish()


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Fingerprints of texts and of their edited forms: the last half of the code points replaced by the first as many of the next document's.

    The next document has the next smaller id; after the smallest comes the largest. Rows with equal ids follow each other by row key, rows
    without an id come last. Documents are dealt to shards by ranges of id; the first document of the shard below is sent along. Likeness
    is 1 for equal canonical bytes and 0 otherwise, compared directly. Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = rows.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)] or [0.5], 100 * shards)).first()[0] or []
    edges = sorted(set(edges))[: shards - 1]
    cuts: Column = F.array(*[F.lit(e).cast("long") for e in edges]) if edges else F.array().cast("array<long>")
    shard = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(cuts, lambda e: e < F.col("doc_id")))).cast("int")
    heads = sorted((r.s, r.head) for r in rows.select(shard.alias("s"), "doc_id").groupBy("s").agg(F.max("doc_id").alias("head")).collect())
    sent = [(heads[k - 1][1], s) for k, (s, _) in enumerate(heads)]  # the shard below's first row, or for the lowest shard that of the highest
    targets = spark.createDataFrame(sent, "head long, target int").groupBy("head").agg(F.collect_list("target").alias("targets"))
    joined = rows.join(F.broadcast(targets), rows.doc_id.eqNullSafe(targets["head"]), "left")  # a row a shard
    own = F.array(F.struct(shard.alias("shard"), F.lit(False).alias("extra")))
    copies = F.transform(F.coalesce("targets", F.array().cast("array<int>")), lambda t: F.struct(t.alias("shard"), F.lit(True).alias("extra")))
    dealt = joined.select("doc_id", "key", "text", F.explode(F.concat(own, copies)).alias("to")).select("doc_id", "key", "text", "to.shard", "to.extra")
    packed = dealt.mapInArrow(_compress, "doc_id long, key long, shard int, extra boolean, z binary")
    ordered = packed.repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions("extra", F.desc_nulls_last("doc_id"), "key")
    found = ordered.mapInArrow(_edit, "doc_id long, key long, n_chars long, edited_sha256 string, digest string, edited_digest string, near_edited double, near_next double")
    found = materialize(found, "edited")
    out = _numbered(found, collisions(docs, found, id_col, text_col))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("digest").alias("fingerprint"),
        F.when(F.col("near_edited") == 1, F.col("digest")).otherwise(F.col("edited_digest")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
