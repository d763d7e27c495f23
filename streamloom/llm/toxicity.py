"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

McMahan et al.: Ad Click Prediction: a View from the Trenches (2013). Each coordinate has its own learning rate; L1 leaves most
weights at exactly 0, so the model is a short list of (feature, weight) that every task can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytefeatures import chunks, mixed, word_hashes
from .common import held_out, materialize, row_key

#: Hashed features; the model holds at most so many weights.
FEATURES = 1 << 20
#: Labelled rows that the model learns from, at most: those with the least hash of their id.
SAMPLE_ROWS = 20_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 0.3, 1.0, 16.0, 0.5
THRESHOLD = 0.3
#: Bytes of a word that stand for all words that begin with them.
STEMS = (4, 5, 6, 7, 8)
#: A feature that occurs so often in a text, or more, counts as a further one.
TIMES = (2, 4)

_SALTS = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]

_STEM_SALTS = [np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0x2127599BF4325C37, 0x880355F21E6D1965)]


def features(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number) of words, words cut to stems, pairs of neighbours, and pairs with one or two words between; repeats included."""
    h, doc, short = word_hashes(part, offsets, STEMS)
    found, of = [mixed(h ^ _SALTS[0])], [doc]
    for k, stem in enumerate(short):
        found.append(mixed(stem ^ _STEM_SALTS[k]))
        of.append(doc)
    for gap in (1, 2, 3):
        same = doc[gap:] == doc[:-gap]
        found.append(mixed(h[:-gap][same] * _SALTS[gap] + h[gap:][same]))
        of.append(doc[gap:][same])
    return (np.concatenate(found) & np.uint64(FEATURES - 1)).astype(np.int64), np.concatenate(of)


def level(idx: np.ndarray, times: int) -> np.ndarray:
    """The features that stand for features that occur `times` times or more."""
    return (mixed(idx.astype(np.uint64) * _SALTS[0] + np.uint64(times)) & np.uint64(FEATURES - 1)).astype(np.int64)


def with_levels(idx: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Different pairs, as text number * FEATURES + feature, of features with repeats: each, and one more for each of TIMES that it reaches in its text."""
    both, n = np.unique(doc * FEATURES + idx, return_counts=True)
    found = [both]
    for times in TIMES:
        often = both[n >= times]
        found.append(often // FEATURES * FEATURES + level(often % FEATURES, times))
    return np.unique(np.concatenate(found))


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) from (different features, label) of each text, in the order given.

    A text moves a coordinate by less than 1, so one that too few texts have can never pass L1: leaving it out changes no result.
    """
    seen = np.zeros(FEATURES, np.int32)
    for idx, _ in rows:
        seen[idx] += 1
    useful = seen * epochs > L1
    for k, (idx, label) in enumerate(rows):
        rows[k] = (idx[useful[idx]], label)
    z, n = np.zeros(FEATURES), np.zeros(FEATURES)
    bias_z = bias_n = 0.0

    def weight(z, n):
        return -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2) * (np.abs(z) > L1)

    for _ in range(epochs):
        for idx, label in rows:
            w = weight(z[idx], n[idx])
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            root = np.sqrt(n[idx])
            z[idx] += g - (np.sqrt(n[idx] + g * g) - root) / ALPHA * w
            n[idx] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    return weight(z, n), float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[np.ndarray, int]] = []
    for b in batches:
        labels = b.column(1).to_numpy(zero_copy_only=False)
        for first, part, offsets in chunks(b.column(0)):
            idx, doc = features(part, offsets)
            both = with_levels(idx, doc)
            cuts = np.searchsorted(both, np.arange(len(offsets)) * FEATURES)
            rows += [((both[a:z] % FEATURES).astype(np.int32), int(labels[first + k])) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    weights, bias = fit(rows)
    kept = np.nonzero(weights)[0]
    yield pa.RecordBatch.from_arrays(
        [pa.array([kept.astype("<i4").tobytes()]), pa.array([weights[kept].astype("<f8").tobytes()]), pa.array([bias])], ["idx", "weight", "bias"]
    )


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model, from rows of `labels` (doc_id, toxic) that are not held out; an id with several labels is toxic if one is.

    The sample is bounded, so it is learnt from in one task; its texts are used whole. Without labels all weights are 0.
    """
    ids = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = materialize(texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label"), "toxic-sample")  # `limit` bounds ids
    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "label")
    model = ordered.mapInArrow(_train, "idx binary, weight binary, bias double").first()
    if model is None:
        return {"idx": np.zeros(0, np.int64), "weight": np.zeros(0), "bias": 0.0}
    return {"idx": np.frombuffer(model.idx, "<i4"), "weight": np.frombuffer(model.weight, "<f8"), "bias": model.bias}


def dense(model: dict) -> tuple[np.ndarray, np.ndarray]:
    """All weights, and which features count in themselves or if they are repeated; made once for each model that arrives at a worker."""
    if "dense" not in model:
        weights = np.zeros(FEATURES)
        weights[model["idx"]] = model["weight"]
        every = np.arange(FEATURES)
        model["dense"] = weights, np.logical_or.reduce([weights != 0, *(weights[level(every, t)] != 0 for t in TIMES)])
    return model["dense"]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (weights, watched) = shared.value, dense(shared.value)
        for b in batches:
            total = np.full(b.num_rows, model["bias"])
            for first, part, offsets in chunks(b.column(b.num_columns - 1)):
                idx, doc = features(part, offsets)
                used = watched[idx]
                both = with_levels(idx[used], doc[used])
                np.add.at(total, first + both // FEATURES, weights[both % FEATURES])
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], [*b.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, score, predicted): a row per row of `docs`; null and empty texts get the bias alone.

    `key` (row_key) tells apart rows that share an id but not a text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_score(shared), "doc_id long, key long, score double")
    return found.select("doc_id", "key", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _keep(shared, column: int):
    scored = _score(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.RecordBatch.from_arrays([b.column(column)], ["text"])
            total = next(scored(iter([texts]))).column(0).to_numpy()
            yield b.filter(pa.array(total < THRESHOLD))

    return run


def nontoxic(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose score is under the threshold. No row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, docs.columns.index(text_col)), docs.schema)
