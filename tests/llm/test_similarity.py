"""Near-duplicates, licenses and lines that lie at their thresholds, against definitions written anew here."""

import re

import numpy as np
import pytest

import corpus_pipeline
from streamloom.llm import licenses, linededup, neardup, queries, setjoin


def alike(sets, least=0.8):
    """The pairs of numbers of sets with a Jaccard similarity of `least` or more."""
    return [(a, b) for a in range(len(sets)) for b in range(a) if len(x := sets[a] & sets[b]) >= least * (len(sets[a]) + len(sets[b]) - len(x))]


def firsts(n, pairs):
    """Of each component, the least number."""
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return sorted(set(label))


def five_words(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_duplicates_are_five_words_at_similarity_08(spark, sf_dir):
    """All pairs of 0.8 and no others: random edits that lie on both sides of it, and the given documents."""
    r = np.random.default_rng(5)
    texts = []
    for n in (4, 5, 6, 9, 30, 60, 200):
        for _ in range(4):
            base = [f"w{r.integers(10**6)}" for _ in range(n)]
            for edits in range(5):
                w = list(base)
                for at in r.choice(n, min(edits, n), replace=False):
                    w[at] = f"x{r.integers(10**6)}"
                texts.append(" ".join(w))
    texts += [t.text or "" for t in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").select("text").collect()]
    sets = [five_words(t) for t in texts]
    want = firsts(len(texts), alike(sets))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = dict(corpus_pipeline.STAGES)["near duplicates"]
    assert sorted(x.doc_id for x in near(spark, docs, sf_dir).collect()) == want and len(want) < len(texts) - 20


def test_short_notices_and_kin(spark):
    header = "it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
    texts = {
        1: "some text\nAll rights reserved.", 2: header.format("", 2), 3: header.format("", 3), 4: "modify " + header.format("Lesser ", "2.1"), 5: header.format("Affero ", 3),
        6: "// SPDX-License-Identifier: MIT", 7: "all rights are reserved", 8: header.format("", 1), 9: header.format("Lesser ", 3),
    }
    found = licenses.licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = {(1, "All-Rights-Reserved"), (2, "GPL-2.0"), (3, "GPL-3.0"), (4, "LGPL-2.1"), (5, "AGPL-3.0"), (6, "MIT (SPDX)"), (9, "LGPL-3.0")}
    assert {(r.doc_id, r.license) for r in found} == want
    assert [(r.first_word, r.last_word) for r in found if r.doc_id == 1] == [(2, 4)]


def test_op3_finds_every_rights_line(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {r.doc_id for r in docs if "all rights reserved" in (r.text or "").lower()}
    got = {r.doc_id for r in queries.op3_licenses(spark, sf_dir).collect() if r.license == "All-Rights-Reserved"}
    assert got == want and want


def kept_lines(spark, lines):
    """The numbers of the lines that stay, each a document."""
    found = linededup.deduplicated(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    return sorted(r.doc_id for r in found if r.text)


def test_lines_parted_by_tabs(spark):
    cells = [f"cell{k:03d}value" for k in range(40)]
    other = [*cells[:20], "changed", *cells[21:]]
    assert kept_lines(spark, ["\t".join(cells), "\t".join(other), " \t ".join(cells), "something else"]) == [0, 3]


@pytest.mark.parametrize("n", [4, 8, 12, 16, 20, 24, 40, 400])
def test_recall_by_set_size(n):
    """Of pairs of sets of n and n / 0.8 shingles, one in the other, nearly all share a band."""
    r = np.random.default_rng(n)
    whole = r.integers(0, 2**64, (2000, n * 5 // 4), np.uint64)
    x = setjoin.signed(whole.ravel(), np.full(len(whole), whole.shape[1]))
    y = setjoin.signed(whole[:, :n].ravel(), np.full(len(whole), n))
    assert (x[:, :-1] == y[:, :-1]).any(axis=1).mean() >= 0.985
    apart = np.bitwise_count((x[:, -1] ^ y[:, -1]).view(np.uint64))
    assert (apart <= setjoin.APART).mean() >= 0.998


def test_recall_of_lines(spark):
    """Lines of the documents with random edits: what of the pairs of 0.8 and more, by all characters, is in one component."""
    r = np.random.default_rng(4)
    lines = sorted({" ".join(x.lower().split()) for t in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() for x in (t.text or "").split("\n")} - {""})
    base = [lines[k] for k in r.choice(len(lines), 150, replace=False)]
    edited = []
    for x in base:
        for n in (1, 2, 4, 8, 12):
            y = list(x)
            for at in r.choice(len(y), min(n, len(y)), replace=False):
                y[at] = "#"
            edited.append(" ".join("".join(y).split()))
    every = sorted({*base, *edited})
    pairs = alike([{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in every])
    ids = {x: k for k, x in enumerate(every)}
    df = spark.createDataFrame([(k, x) for x, k in ids.items()], "doc_id long, text string")
    docs = linededup.deduplicated(df).collect()
    stay = {r.doc_id for r in docs if r.text}
    want = set(firsts(len(every), pairs))
    assert want <= stay and len(stay - want) <= 0.02 * (len(every) - len(want)) and len(pairs) > 300


@pytest.mark.parametrize("task_rows", [1, 3, 50, 10**6])
def test_buckets_lose_no_pair(spark, monkeypatch, task_rows):
    """Buckets of all sizes, cut into any pieces and cells: the components are those of all pairs."""
    import pyarrow as pa

    r = np.random.default_rng(6)
    texts = []
    for k, n in enumerate((1, 2, 3, 9, 30, 80)):
        base = [f"w{r.integers(10**6)}" for _ in range(40)]
        for _ in range(n):
            w = list(base)
            for at in r.choice(40, 3, replace=False):
                w[at] = f"x{r.integers(10**6)}"
            texts.append((k, " ".join(w)))
    sets = [five_words(t) for _, t in texts]
    sketch = setjoin.signed(*neardup.shingles([t for _, t in texts]))[:, -1].tolist()
    rows = [(k, i, sketch[i]) for i, (k, _) in enumerate(texts)]

    def batches():
        for at in range(0, len(rows), task_rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + task_rows])], ["bucket", "id", "sketch"])

    monkeypatch.setattr(setjoin, "PIECE_ROWS", 16)
    met = pa.Table.from_batches(list(setjoin._meet(batches()))).to_pylist()
    assert all(m["a"] is not None and (m["b"] is None) == (m["bucket"] is not None) for m in met)
    assert {m["a"] for m in met if m["b"] is None} >= {i for k, i, _ in rows if k in (0, 5)}
    df = spark.createDataFrame(rows, "bucket long, id long, sketch long")
    known = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "id long, text string")
    out = setjoin.similar_components(df, lambda wanted: known.join(wanted, "id"), neardup.shingles, cell_rows=7).collect()
    label = {x.node: x.component for x in out}
    want = firsts(len(texts), [(a, b) for a, b in alike(sets) if texts[a][0] == texts[b][0]])
    assert sorted({label.get(i, i) for i in range(len(texts))}) == want


def test_a_full_stop_more(spark):
    line = "the quick brown fox jumps over the lazy dog on the near river bank"
    assert kept_lines(spark, [line, line + ".", line.replace("fox", "ofx"), "Total: 1234 items were counted in the shop and in the store last week", "Total: 1235 items were counted in the shop and in the store last week"]) == [0, 3]


def test_short_lines_with_one_changed_word(spark):
    """All pairs by brute force over five-character shingles; none of these is a pair of word bigrams."""
    base = ["la casa de la familia no tiene jardin pero tiene balcon grande", "total for the month of march 2019 was 1234 in all our shops", "日本語の文章はここにありますそしてとても長いので似ています"]
    near = [base[0].replace(" no ", " se "), base[1].replace("1234", "1235"), base[2] + "ね"]
    lines = [*base, *near, "a line of its own"]
    cut = [{x[k : k + 5] for k in range(len(x) - 4)} for x in lines]
    assert len(alike(cut)) == 3 and kept_lines(spark, lines) == firsts(len(lines), alike(cut))


def test_op7_is_native(spark, monkeypatch):
    """No Python on the executors; and a very long line costs no more a character than others."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(DataFrame, name, refused)
    long = " ".join(f"w{k * 7919 % 100003}" for k in range(40_000))
    assert kept_lines(spark, [long, "a line of its own", long.replace("w7919 ", "x "), "A  line\tof its own "]) == [0, 1]


def test_native_recall_by_set_size(spark):
    """Of pairs of lines of n and n / 0.8 shingles, one in the other, nearly all share a bucket and have sketches that are near."""
    r = np.random.default_rng(11)
    rows, sizes = [], (4, 8, 16, 24, 40, 100, 400)
    for n in sizes:
        for k in range(400):
            whole = "".join(map(chr, r.integers(0x4E00, 0x9FFF, n * 5 // 4 + 4)))
            rows += [(n, k, 0, whole), (n, k, 1, whole[: n + 4])]
    df = spark.createDataFrame(rows, "n int, k int, side int, text string")
    found = {(x.n, x.k, x.side): x for x in linededup.signed(df, ["n", "k", "side"]).collect()}
    for n in sizes:
        pairs = [(found[n, k, 0], found[n, k, 1]) for k in range(400)]
        shared = np.mean([any(a is not None and a == b for a, b in zip(x["keys"], y["keys"])) for x, y in pairs])
        near = np.mean([((x.sketch ^ y.sketch) & (2**64 - 1)).bit_count() <= setjoin.APART for x, y in pairs])
        assert shared >= 0.98 and near >= 0.995
