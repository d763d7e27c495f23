"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

All classifiers see hashed byte n-grams of the folded whole text, as relative frequencies. Between families, too, each pair has a
machine of its own. Votes decide; ties go to the larger sum of margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytefeatures import chunks, gram_values
from .common import held_out, materialize

#: Families of closely related languages, by ISO 639-1 code; a language that is in none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
#: Hashed n-grams; n goes up to GRAMS bytes.
FEATURES = 4096
GRAMS = 3
#: Labelled rows the machines learn from, at most: an equal share of each language, those with the least hash of their id.
SAMPLE_ROWS = 8000
STEPS = 200
#: Texts whose frequencies are held at once.
ROWS = 256
RIDGE = 1e-3
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_SPREAD = np.uint32(0x9E3779B1)


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def _bins(part: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for n, (value, whole) in enumerate(gram_values(part, offsets, GRAMS), 1):
        yield ((value + np.uint32(n)) * _SPREAD) >> np.uint32(32 - FEATURES.bit_length() + 1), whole


def frequencies(part: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of relative n-gram frequencies for each text."""
    rows = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    doc = np.repeat(np.arange(len(rows)), np.diff(offsets))
    for bins, whole in _bins(part, offsets):
        flat = doc[whole] * FEATURES + bins[whole]
        rows += np.bincount(flat, minlength=rows.size).reshape(rows.shape)
    return rows / np.maximum(1, np.diff(offsets))[:, None].astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear machine with squared hinge loss, by accelerated gradient steps; y is -1 or 1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    a = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    v = np.ones(a.shape[1], np.float32)
    for _ in range(10):
        v = a.T @ (share * (a @ v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    rate = 1 / (2 * top * 1.1 + RIDGE)
    w, ahead, t = np.zeros(a.shape[1], np.float32), np.zeros(a.shape[1], np.float32), 1.0
    for _ in range(STEPS):
        slack = np.maximum(0, 1 - y * (a @ ahead)) * share
        step = ahead - rate * (RIDGE * ahead - 2 * (a.T @ (slack * y)))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = step + np.float32((last - 1) / t) * (step - w), step
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """The model from rows of frequencies: a machine for each pair of families, and for each pair of languages in a family."""
    named = np.array(langs)
    families = np.array([family(x) for x in langs])
    scale = np.maximum(x.std(axis=0), 1e-4)
    scaled = (x - x.mean(axis=0)) / scale
    machines = []

    def pairs(names: list[str], of: np.ndarray) -> None:
        for a, b in combinations(names, 2):
            rows = (of == a) | (of == b)
            w, bias = fit_svm(scaled[rows], np.where(of[rows] == a, 1.0, -1.0).astype(np.float32))
            machines.append((a, b, (w / scale).astype(np.float64), bias - float((w * x.mean(axis=0) / scale).sum())))

    names = sorted(set(families))
    pairs([f"family:{f}" for f in names], np.array([f"family:{f}" for f in families]))
    members = {f: sorted(set(named[families == f])) for f in names}
    for f in names:
        pairs(members[f], named)
    return {"members": members, "machines": machines}


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    x, langs = [], []
    for b in batches:
        named = b.column(1).to_pylist()
        for first, part, offsets in chunks(b.column(0)):
            x.append(frequencies(part, offsets))
            langs += named[first : first + len(offsets) - 1]
    if langs:
        model = fit(np.concatenate(x), langs)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """The model, from rows that have a language, a letter in the text, and are not held out; None if there are none.

    The sample is bounded, so it is learnt from in one task; its texts are used whole.
    """
    import pickle

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    known = rows.select("lang").distinct().count()
    if not known:
        return None
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = rows.withColumn("nth", nth).filter(F.col("nth") <= max(1, sample_rows // known)).select("doc_id", "lang")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = materialize(texts.filter(F.col("text").rlike(r"\p{L}")).join(F.broadcast(ids), "doc_id"), "lang-sample")  # sample_rows bounds ids
    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "lang")
    found = ordered.mapInArrow(_train, "model binary").first()
    return found and pickle.loads(found.model)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _choose(names: list[str], margins: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(winner's number, its probability) over `names`, by votes and then margins."""
    votes, total = np.zeros((len(names), n)), np.zeros((len(names), n))
    for (i, a), (j, b) in combinations(enumerate(names), 2):
        p = _sigmoid(2 * margins[a, b])
        votes[i] += p > 0.5
        votes[j] += p <= 0.5
        total[i] += p
        total[j] += 1 - p
    best = (votes * (len(names) + 1) + total).argmax(axis=0)
    share = total[best, np.arange(n)] / max(1, len(names) - 1) if len(names) > 1 else np.ones(n)
    return best, share


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        machines = model["machines"] if model else []
        weights = np.array([w for _, _, w, _ in machines]).reshape(len(machines), FEATURES).T
        families = sorted(model["members"]) if model else []
        for b in batches:
            lang, score = np.full(b.num_rows, UNDETERMINED, object), np.zeros(b.num_rows)
            letters = np.array([bool(t and _LETTER.search(t)) for t in b.column(1).to_pylist()], bool)
            for first, part, offsets in chunks(b.column(1)) if model else ():
                n = len(offsets) - 1
                total = np.empty((n, len(machines)))
                for at in range(0, n, ROWS):  # a row of frequencies a text, whatever the number of machines
                    to = min(n, at + ROWS)
                    total[at:to] = frequencies(part[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]) @ weights
                margins = {(x, y): total[:, k] + bias for k, (x, y, _, bias) in enumerate(machines)}
                which, sure = _choose([f"family:{f}" for f in families], margins, n)
                for k, f in enumerate(families):
                    rows = np.nonzero(which == k)[0]
                    some = {pair: m[rows] for pair, m in margins.items()}
                    best, share = _choose(model["members"][f], some, len(rows))
                    lang[first + rows] = np.array(model["members"][f], object)[best]
                    score[first + rows] = sure[rows] * share
            lang[~letters], score[~letters] = UNDETERMINED, 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): a row per row of `docs`; `und` with score 0 for null texts, texts without a letter, and where nothing was learnt."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights a machine
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
