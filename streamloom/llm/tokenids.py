"""Token ids as files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file is a Parquet table of blocks, so that Spark's own readers, writers and commit protocol serve it in any store. A
block holds whole documents in ascending order of (doc_id, crc32 of the ids), a long one alone:

    shard, block     order of the blocks
    before           ids in the shard's earlier blocks
    doc_ids          8 bytes a piece, little-endian (nulls: `null_ids` has their places)
    counts           4 bytes a piece: ids of each document
    control          2 bits an id, four to a byte, lowest first: length in bytes less 1
    data             each id's rank, little-endian, in as few bytes as control says

The table of ranks (token, n, rank) lies beside it: rank 0 is the most frequent id. Lemire, Kurz, Rupp: Stream VByte (2017).
"""

from __future__ import annotations

import re
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_root, discard, materialize

#: Ids in a block of several documents: bounds what a task holds at once.
BLOCK_IDS = 1 << 20
#: Most different tokens the rank table may have; it goes to every task.
MAX_VOCABULARY = 1 << 20
#: Pieces of text whose ids a worker remembers in each of two generations.
CACHE_WORDS = 600_000
BLOCK_SCHEMA = "shard int, block int, doc_ids binary, null_ids binary, counts binary, before long, n_ids long, control binary, data binary"

_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    top = int(values.max()) if len(values) else 0
    size = max(1, (top.bit_length() + 7) // 8)  # bytes of the greatest value
    wide = 1 if size == 1 else 2 if size == 2 else 4
    v = np.ascontiguousarray(values, f"<u{wide}")
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    extra = padded[: len(v)]
    for k in range(1, size):
        extra += v >= 1 << 8 * k
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.ones((len(v), wide), bool)
    for k in range(1, wide):
        used[:, k] = extra >= k
    return control.tobytes(), v.view(np.uint8)[used.reshape(-1)].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The `n` values that `encode` wrote."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    most = int(lengths.max()) if n else 1
    wide = 1 if most == 1 else 2 if most == 2 else 4
    used = np.ones((n, wide), bool)
    for k in range(1, wide):
        used[:, k] = lengths > k
    out = np.zeros(n * wide, np.uint8)
    out[used.reshape(-1)] = np.frombuffer(data, np.uint8)
    return out.view(f"<u{wide}")


def width(most: int) -> str:
    """How ids up to `most` are held before they are encoded."""
    return "<u2" if most < 1 << 16 else "<u4"


def _load(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


#: A character from which on texts may hold marks that join with letters.
_MARKS = re.compile("[\u0300-\U0010ffff]")
_TAIL = b".,;:!?"
#: Bytes by class: white space, full stop and comma, letters and digits (of ASCII and of two-byte characters up to U+017F), others, and those that make a text special.
_CLASS = bytes(
    32 if c in b" \t\n\r\x0b\x0c" else 46 if c in b".," else 97 if chr(c).isalnum() and c < 128 or 0x80 <= c < 0xC0 or 0xC3 <= c <= 0xC5 else 88 if c >= 0xC0 else 35
    for c in range(256)
)


def _apart(text: bytes) -> bytes:
    """A full stop or comma that ends a word before a space or a new line set apart; texts where one ends anything else stay as they are.

    Tokens stay the same: white space is dropped, and letters and marks are never joined.
    """
    kinds = text.translate(_CLASS)
    if b"X" in kinds or b"#. " in kinds or b".. " in kinds or b"\xc3\x97" in text or b"\xc3\xb7" in text:
        return text
    return text.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n").replace(b",\n", b" ,\n")


_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


class _WordCache:
    """Ids of pieces of text, in two generations: what was not used since the last change of generation goes."""

    def __init__(self, path: str, most: int):
        from tokenizers import normalizers, pre_tokenizers

        self.full, self.plain, self.most = _load(path), _load(path), most
        self.width = width(self.full.get_vocab_size() - 1)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        spelled = self.plain.get_vocab()
        self.ends = np.zeros(max(spelled.values()) + 1, bool)
        for token, i in spelled.items():
            self.ends[i] = token.endswith("</w>")
        self.special = sorted({t.content.lower().encode() for t in self.full.get_added_tokens_decoder().values()})
        self.now: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, pieces: set[bytes]) -> None:
        """Plain words are encoded many at once: each ends with a token that says so. Marks behind a plain word are a word of their own."""
        now, old = self.now, self.old
        plain, whole, cut = [], [], []
        for p in pieces:
            ids = old.get(p)
            if ids is not None:
                now[p] = ids
            elif any(x in p.lower() for x in self.special):
                whole.append(p)
            elif _PLAIN(p):
                plain.append(p)
            elif _PLAIN(core := p.rstrip(_TAIL)):
                cut.append((p, core, p[len(core) :]))
            else:
                whole.append(p)
        parts = {x for _, core, tail in cut for x in (core, tail)}
        for p in parts.difference(pieces):
            if p not in now:
                ids = old.get(p)
                if ids is not None:
                    now[p] = ids
                else:
                    (plain if _PLAIN(p) else whole).append(p)
        for at in range(0, len(plain), 512):
            some = plain[at : at + 512]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, self.width)
            ends = ((np.nonzero(self.ends[ids])[0] + 1) * ids.itemsize).tolist()
            if len(ends) != len(some):
                raise ValueError("this tokenizer does not mark the ends of words")
            raw = ids.tobytes()
            now.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends], ends))))
        for p, e in zip(whole, self.full.encode_batch_fast([p.decode() for p in whole], add_special_tokens=False)):
            now[p] = np.array(e.ids, self.width).tobytes()
        for p, core, tail in cut:
            now[p] = now[core] + now[tail]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now
        known, out, todo, lacking = self.now, [], [], set()
        for t in texts:
            low = t.lower().encode()
            as_is = any(x in low for x in self.special)  # the tokenizer looks for these before it lower-cases, so their case counts
            pieces = (t.encode() if as_is or _MARKS.search(t) else _apart(low)).split()
            ids = list(map(known.get, pieces))
            if None in ids:
                gaps = [k for k, x in enumerate(ids) if x is None]
                lacking.update(pieces[k] for k in gaps)
                todo.append((len(out), ids, gaps, [pieces[k] for k in gaps]))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        if lacking:
            self.learn(lacking)
            for n, ids, gaps, missed in todo:
                for k, p in zip(gaps, missed):
                    ids[k] = known[p]
                out[n] = b"".join(ids)
        return out


def word_encoder(path: str, cache_words: int = CACHE_WORDS) -> Callable[[list[str]], list[bytes]]:
    """Encodes texts piece by piece between ASCII white space, and remembers pieces for as long as the worker lives.

    For tokenizers like word_bpe_49k.json, which drop white space, never join across it, part letters from all else, lower case, and mark the ends of
    words: its ids for a text are those of its pieces, one after another.
    """
    kept = sys.modules.setdefault("_streamloom_worker", types.ModuleType("_streamloom_worker")).__dict__
    if path not in kept:
        kept[path] = _WordCache(path, cache_words)
    return kept[path]


def whole_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes whole texts: for tokenizers of any kind."""
    tokenizer = _load(path)
    wide = width(tokenizer.get_vocab_size() - 1)
    return lambda texts: [np.array(e.ids, wide).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _tokenize(make_encoder, end_id: int, most: int):
    """A row per document, and at the end of a task one with the counts of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = make_encoder()
        end = np.array([end_id], width(most)).tobytes()
        total = np.zeros(0, np.int64)
        names, none = ["doc_id", "ids", "counts"], pa.array([None], pa.binary())
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [x + end for x in ids([t or "" for t in part.column(1).to_pylist()])]
                n = np.bincount(np.frombuffer(b"".join(found), width(most)), minlength=len(total))
                n[: len(total)] += total
                total = n
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary()), pa.nulls(len(found), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), none, pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return run


def tokenize(docs: DataFrame, make_encoder, end_id: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, counts): little-endian ids up to `most`, of its `width`, with `end_id` last (a null text is empty); where ids is null, the counts of a task's tokens. Materialized."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(_tokenize(make_encoder, end_id, most), "doc_id long, ids binary, counts binary"), "ids")


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in batches:
        for x in b.column(0).to_pylist():
            n = np.frombuffer(x, "<i8")
            if len(n) > len(total):
                total = np.pad(total, (0, len(n) - len(total)))
            total[: len(n)] += n
    seen = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token", "n"])


def rank_table(ids: DataFrame) -> list[tuple[int, int]]:
    """(token, n) by falling frequency, ties by token: bounded by the vocabulary, and checked."""
    counts = ids.filter("ids is null").select("counts").mapInArrow(_add, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"over {MAX_VOCABULARY} different tokens")
    return sorted(((r.token, r.n) for r in rows), key=lambda r: (-r[1], r[0]))


def _pack(rank_of, most: int):
    """Ids to ranks, of the same width, for all documents of a batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = rank_of.value.astype(width(most))
        for b in batches:
            ids = b.column("ids").cast(pa.large_binary())
            offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
            data = np.frombuffer(ids.buffers()[2] or b"", width(most), (offsets[-1] - offsets[0]) // ranks.itemsize, offsets[0]) if len(ids) else ranks[:0]
            moved = (offsets - offsets[:1]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(moved.tobytes()), pa.py_buffer(ranks[data].tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("crc"), b.column("shard"), packed], ["doc_id", "crc", "shard", "ranks"])

    return run


def _blocks(most: int):
    """Sorted documents to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _to_blocks(batches, width(most))

    return run


def _to_blocks(batches: Iterator[pa.RecordBatch], wide: str) -> Iterator[pa.RecordBatch]:
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    shard, block, before, held, waiting = None, 0, 0, [], 0

    def flush() -> pa.RecordBatch:
        nonlocal block, before, waiting
        ids = [d for d, _ in held]
        control, data = encode(np.concatenate([v for _, v in held]))
        doc_ids = np.array([d or 0 for d in ids], "<i8").tobytes()
        null_ids = np.array([k for k, d in enumerate(ids) if d is None], "<u4").tobytes()
        counts = np.array([len(v) for _, v in held], "<u4").tobytes()
        row = [shard, block, doc_ids, null_ids, counts, before, waiting, control, data]
        block, before, waiting = block + 1, before + waiting, 0
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

    for b in batches:
        for doc_id, to, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "shard", "ranks"))):
            values = np.frombuffer(raw, wide)
            n = len(values)
            if held and (to != shard or waiting + n > BLOCK_IDS):
                yield flush()
            if to != shard:
                shard, block, before = to, 0, 0
            held.append((doc_id, values))
            waiting += n
    if held:
        yield flush()


def write_blocks(ids: DataFrame, path: str, most: int, shards: int | None = None) -> None:
    """Write `ids` (of `tokenize`, with the same `most`) to `path`/blocks and `path`/ranks.

    Documents are dealt to shards by ranges of doc_id, so each shard is one task's; equal ids are ordered by the crc32 of
    their tokens, and rows that are wholly equal in any order, which gives equal files. A null id comes first.
    """
    spark = ids.sparkSession
    ranked = rank_table(ids)
    ids = ids.filter("ids is not null")
    of = np.zeros(max((t for t, _ in ranked), default=0) + 1, "<u4")
    of[[t for t, _ in ranked]] = np.arange(len(ranked))
    spark.createDataFrame([(t, n, k) for k, (t, n) in enumerate(ranked)], "token long, n long, rank int").coalesce(1).write.parquet(f"{path}/ranks")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = ids.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)] or [0.5], 100 * shards)).first()[0] or []
    edges = sorted(set(edges))[: shards - 1]
    cuts = F.array(*[F.lit(e).cast("long") for e in edges]) if edges else F.array().cast("array<long>")
    shard = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(cuts, lambda e: e < F.col("doc_id"))))
    sized = ids.select("doc_id", F.crc32("ids").alias("crc"), shard.cast("int").alias("shard"), "ids")
    packed = sized.mapInArrow(_pack(spark.sparkContext.broadcast(of), most), "doc_id long, crc long, shard int, ranks binary")
    dealt = packed.repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "crc")
    dealt.mapInArrow(_blocks(most), BLOCK_SCHEMA).write.parquet(f"{path}/blocks")


def _read(token_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_of.value
        for b in batches:
            for row in b.to_pylist():
                values = tokens[decode(row["control"], row["data"], row["n_ids"])].astype("<u4")
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
                ends = np.cumsum(counts)
                missing = np.zeros(len(doc_ids), bool)
                missing[np.frombuffer(row["null_ids"], "<u4")] = True
                starts = ends - counts
                parts = [values[a:z].tobytes() for a, z in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=missing), pa.array(starts + row["base"] + row["before"]), pa.array(counts), pa.array(parts, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return run


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) decoded from the files; start counts the ids of all documents before.

    Where a shard starts is summed over one row a shard; a block has its own place in its shard.
    """
    ranks = spark.read.parquet(f"{path}/ranks").select("token", "rank").collect()
    token_of = spark.sparkContext.broadcast(np.array([r.token for r in sorted(ranks, key=lambda r: r.rank)], "<u4"))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(base), "shard")  # a row a shard: write_blocks bounds their number
    return placed.mapInArrow(_read(token_of), "doc_id long, start long, n_tokens long, ids binary")


def written_tokens(docs: DataFrame, make_encoder, end_id: int, most: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> tuple[str, DataFrame]:
    """Tokenize, write and read back: (path of the files, rows of `read_blocks`). No documents give empty files."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_root(spark)}/tokens-{uuid.uuid4().hex}"
    ids = tokenize(docs, make_encoder, end_id, most, id_col, text_col)
    write_blocks(ids, path, most)
    discard(ids)
    return path, read_blocks(spark, path)
