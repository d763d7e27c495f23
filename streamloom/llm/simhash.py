"""SimHash near-duplicates by anchor-point covering.

The anchors are the codewords of a direct sum of perfect [7,4] Hamming codes. Of each such code every word of seven bits has
exactly one codeword within distance 1 (its covering radius). The 64 bits are cut into three bands of three codes (21 bits;
one bit is in no band). Two fingerprints that differ in at most four bits differ in at most one bit of some band, and
in at most two bits of some pair of bands. A fingerprint is *at home* at the one anchor that covers it, and *visits*
each anchor within covering radius plus threshold: at the home of x, every y near enough to x is a visitor. Homes are compared with visitors, exactly, per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, without_keys
from .components import connected_components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Above so many different fingerprints, pairs of bands serve as keys: 24 bits instead of 12. The links are the same.
WIDE_FROM = 1 << 24
#: Homes or visitors in one compared cell; anchors with more are cut into a grid of cells.
CELL_ROWS = 8192
BLOCK = 1 << 16


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """A hash for each shingle of a whole text in UTF-8, repeats included. Fewer words than a shingle has: one shingle of all; no words: none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(words) - shingle + 1)].tolist()
    ends = ends[shingle - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], "<u8")


def from_hashes(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half the hashes; of no hashes, 0."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def simhash(text: bytes) -> int:
    """Of a whole text in UTF-8; no words: 0."""
    return from_hashes(shingle_hashes(text))


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([simhash(t or b"") for t in b.column(2).cast(pa.binary()).to_pylist()], "<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())], ["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp): one row per row of `docs`; a null or empty text has fingerprint 0. `key` (row_key) tells apart rows that share an id but not a text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_hash_batches, "doc_id long, key long, fp long")


def _hamming_tables(most: int) -> list[list[tuple[int, int]]]:
    """For each word of seven bits: (codeword number, excess) of codewords within 1 + most; excess is the distance over 1."""
    words = [w for w in range(128) if _syndrome(w) == 0]
    return [[(k, max(0, (w ^ c).bit_count() - 1)) for k, c in enumerate(words) if (w ^ c).bit_count() <= 1 + most] for w in range(128)]


def _syndrome(word: int) -> int:
    out = 0
    for bit in range(7):
        if word >> bit & 1:
            out ^= bit + 1
    return out


def _layers(fps: np.ndarray, codes: list[int], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, excess) of all anchors within the total excess `most`, over the numbered seven-bit pieces of each row."""
    tables = _hamming_tables(most)
    width = max(map(len, tables))
    code = np.full((128, width), -1, np.int64)
    extra = np.full((128, width), 99, np.int64)
    for w, entries in enumerate(tables):
        for k, (c, e) in enumerate(entries):
            code[w, k], extra[w, k] = c, e
    rows, anchor, excess = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)
    for piece in codes:
        bits = ((fps[rows] >> np.uint64(7 * piece)) & np.uint64(127)).astype(np.int64)
        total = excess[:, None] + extra[bits]
        i, k = np.nonzero(total <= most)
        rows, anchor, excess = rows[i], anchor[i] * 16 + code[bits[i], k], total[i, k]
    return rows, anchor, excess


def bands(wide: bool) -> list[tuple[list[int], int]]:
    """(numbers of seven-bit pieces, most differing bits) of each band: whoever is near agrees so far in one of them."""
    groups = [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    if wide:
        return [(a + b, MAX_BITS * 2 // 3) for a, b in combinations(groups, 2)]
    return [(g, MAX_BITS // 3) for g in groups]


def _cover(wide: bool):
    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(0).to_numpy(zero_copy_only=False).view("<u8")
            for at in range(0, len(whole), 4096):
                fps = whole[at : at + 4096]
                for band, (pieces, most) in enumerate(bands(wide)):
                    rows, anchor, excess = _layers(fps, pieces, most)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor * 4 + band), pa.array(fps[rows].view("<i8")), pa.array(excess == 0)], ["anchor", "fp", "home"]
                    )

    return cover


def _spanning(homes: np.ndarray, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is near: fewer than there are nodes, with the same components as all pairs within MAX_BITS."""
    nodes = np.unique(np.concatenate([homes, visitors]))
    label = np.arange(len(nodes))
    at_home, at = np.searchsorted(nodes, homes), np.searchsorted(nodes, visitors)
    step = max(1, (1 << 20) // max(1, len(visitors)))
    for k in range(0, len(homes), step):
        near = np.bitwise_count(homes[k : k + step, None] ^ visitors[None, :]) <= MAX_BITS
        for i in np.nonzero(near.sum(axis=1) > 1)[0]:
            linked = label[at[near[i]]]
            known = np.unique(np.append(linked, label[at_home[k + i]]))
            if len(known) > 1:
                label[np.isin(label, known)] = known[0]
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; a cell has at most about CELL_ROWS homes and as many visitors."""
    kept: list[tuple[np.ndarray, ...]] = []

    def finish() -> pa.RecordBatch:
        fp, home = (np.concatenate([k[n] for k in kept]) for n in (0, 1))
        u, v = _spanning(fp[home], fp)
        return pa.RecordBatch.from_arrays([pa.array(u.view("<i8")), pa.array(v.view("<i8"))], ["u", "v"])

    last = None
    for b in batches:
        key = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in ("anchor", "i", "j")], axis=1)
        fp = b.column("fp").to_numpy(zero_copy_only=False).view("<u8")
        home = b.column("home").to_numpy(zero_copy_only=False)
        if not len(fp):
            continue
        cuts = [0, *(np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1).tolist(), len(fp)]
        for a, z in zip(cuts, cuts[1:]):
            this = tuple(key[a])
            if last is not None and this != last:
                if len(kept) > 1 or len(kept[0][0]) > 1:
                    yield finish()
                kept.clear()
            last = this
            kept.append((fp[a:z], home[a:z]))
    if kept:
        yield finish()


def near_links(distinct: DataFrame, cell_rows: int = CELL_ROWS, wide: bool | None = None) -> DataFrame:
    """(u, v) links over a table of different fingerprints (column fp) whose components are those of all pairs within MAX_BITS.

    An anchor with over `cell_rows` rows is cut into a grid: each part of its homes meets each part of its visitors, so a task
    holds a bounded number of rows whatever the data are, and no pair is lost.
    """
    if wide is None:
        wide = distinct.count() > WIDE_FROM
    cover = materialize(distinct.select("fp").mapInArrow(_cover(wide), "anchor long, fp long, home boolean"), "cover")
    hot = (
        cover.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("h"))
        .filter(F.col("n") > cell_rows)
        .select("anchor", F.ceil(F.col("h") / cell_rows).cast("int").alias("hi"), F.ceil(F.col("n") / cell_rows).cast("int").alias("hj"))
    )
    spread = cover.join(hot, "anchor", "left")
    part = lambda n: F.pmod(F.xxhash64("fp", F.lit(n)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cold = spread.filter("hi is null").select("anchor", "fp", "home", F.lit(0).alias("i"), F.lit(0).alias("j"))
    split = spread.filter("hi > 0")
    as_home = split.filter("home").select("anchor", "fp", "home", part("hi").alias("i"), F.explode(every("hj")).alias("j"))
    as_visitor = split.select("anchor", "fp", F.lit(False).alias("home"), F.explode(every("hi")).alias("i"), part("hj").alias("j"))
    cells = cold.unionAll(as_home).unionAll(as_visitor)
    return cells.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(_compare, "u long, v long")


def fingerprint_components(distinct: DataFrame) -> DataFrame:
    """(node, component) over different fingerprints (column fp) that have another within MAX_BITS."""
    return materialize(connected_components(near_links(distinct)), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp, component, component_id): per row of `docs`, its fingerprint and the smallest id reachable over links of MAX_BITS bits or fewer.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows repeat as they come. A null id never is
    a component's smallest, unless the component has no other; `component`, a fingerprint, names each. An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = fingerprint_components(distinct)
    least = (
        distinct.join(found, distinct.fp == found.node, "left")
        .select("fp", "least", F.coalesce("component", "fp").alias("component"))
    )
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = least.select("fp", "component").join(ids, "component").select("fp", "component", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "key", "fp", "component", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, but of each component only one: the least id, and of equal ids the least row key. Of rows that are equal in both, one stays."""
    return first_of_components(docs, materialize(near_duplicates(docs, id_col, text_col), "near"), id_col, text_col)


def first_of_components(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that come first in their component; `found` has (doc_id, key, component) per row of `docs`."""
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")
    first = found.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("component", "first")
    first = materialize(first, "first")  # so that the join below is of two plain exchanges, of which Spark can split a large component's
    pairs = found.join(first, "component").select("doc_id", "key", (order != F.col("first")).alias("late"))
    gone = pairs.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.every("late").alias("late")).filter("late or n > 1")
    return without_keys(docs, materialize(gone.select("doc_id", "key", (~F.col("late")).alias("one")), "late"), id_col, text_col)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
