"""Near-duplicate documents: SimHash components and MinHash bands as candidates, links by the exact Jaccard similarity of sets of word shingles.

Shingles are SHINGLE consecutive words of the text in lower case, a text with fewer words being one. SimHash within `simhash.MAX_BITS` of 64 bits reaches but few pairs of
similarity 0.8 (they differ in some ten bits), so it does not stand alone: the different texts of a SimHash component are one bucket, the bands of their MinHash signatures are
more, and what shares a bucket is compared as `setjoin` describes. A pair is linked if and only if its similarity is 0.8 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, row_key, split_by_keys
from .setjoin import banded, mixed, signed, similar_components
from .simhash import fingerprint_components, first_of_components, from_hashes

SHINGLE = 5


#: Bytes of texts that are hashed together.
BYTES = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POWERS = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    for name, x in (("base", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
        while len(_POWERS[name]) < n:
            have = _POWERS[name]
            _POWERS[name] = np.concatenate([have, have * _U(pow(x, len(have), 1 << 64))])
    return _POWERS["base"][:n], _POWERS["inverse"][:n]


def _hash_texts(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """`shingles` of texts cut into words. The hash of bytes b0, b1, ... is the mixed sum of (b + 1) / base^k: differences of one running sum give it for any span."""
    words = [w for t in texts for w in t or [b""]]
    data = np.frombuffer(b" ".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    base, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * inverse[: len(data)], out=total[1:])
    n = np.array([max(1, len(t)) for t in texts], np.int64)
    count = np.maximum(1, n - SHINGLE + 1)
    first = np.repeat(np.cumsum(n) - n, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(first + SHINGLE, np.repeat(np.cumsum(n), count)) - 1
    a, z = start[first], end[last]
    return mixed((total[z] - total[a]) * base[a]), count


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of each text, one text after another, repeats included; how many each has, at least one). Words are parted by ASCII white space; A-Z count as a-z."""
    out, held, n = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], [], 0
    for t in texts:
        raw = (t or "").encode()
        held.append(raw.lower().split())
        n += len(raw)
        if n > BYTES:
            out.append(_hash_texts(held))
            held, n = [], 0
    if held:
        out.append(_hash_texts(held))
    return np.concatenate([h for h, _ in out]), np.concatenate([c for _, c in out])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The name of each text's set of shingles, its fingerprint, and its buckets."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            hashes, sizes = shingles(part.column("text").to_pylist())
            sets = np.split(hashes, np.cumsum(sizes)[:-1]) if len(sizes) else []
            names = [xxhash.xxh3_128_digest(np.unique(s).tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            fp = np.array([from_hashes(s) for s in sets], "<u8").view("<i8")
            found = signed(hashes, sizes)
            columns = [part.column("doc_id"), part.column("key"), *(pa.array(x) for x in (halves[:, 0], halves[:, 1], fp, found[:, -1])), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "h1", "h2", "fp", "sketch", "bands"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, component): per row of `docs`, the name of its component over links of 0.8 or more. Texts without words, null ones too, are equal."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    cut = materialize(rows.mapInArrow(_sign, "doc_id long, key long, h1 long, h2 long, fp long, sketch long, bands binary"), "signed")
    one = F.struct("doc_id", "key")
    different = cut.groupBy("h1", "h2").agg(F.min(one).alias("row"), F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"))
    sets = materialize(different.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "row", "fp", "sketch", "bands"), "sets")
    near = fingerprint_components(sets.select("fp").distinct())
    linked = sets.select("id", "fp", "sketch").join(near, F.col("fp") == near.node).select(F.xxhash64(F.lit("simhash"), "component").alias("bucket"), "id", "sketch")
    same = sets.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp")  # different sets, one fingerprint
    equal = sets.join(same, "fp").select(F.xxhash64(F.lit("equal"), "fp").alias("bucket"), "id", "sketch")

    def texts_of(wanted: DataFrame) -> DataFrame:
        places = materialize(sets.join(wanted, "id").select("id", "row.doc_id", "row.key"), "places")
        some = split_by_keys(rows, places, ["doc_id", "key"])[0]
        p = places.select("id", F.col("doc_id").alias("_d"), F.col("key").alias("_k")).hint("merge")
        return some.join(p, some.doc_id.eqNullSafe(p["_d"]) & (some.key == p["_k"])).select("id", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["id"])

    found = similar_components(banded(sets).unionAll(linked).unionAll(equal), texts_of, shingles)
    names = materialize(sets.select("id", "h1", "h2").join(found, F.col("id") == found.node, "left").select("h1", "h2", F.coalesce("component", "id").alias("component")), "names")
    out = materialize(cut.select("doc_id", "key", "h1", "h2").join(names, ["h1", "h2"]).select("doc_id", "key", "component"), "near")
    for t in (cut, sets, names):
        discard(t)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, but of each component only one, as `simhash.first_of_components` has it."""
    return first_of_components(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)
