"""Every operator and stage over nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from streamloom.llm import common, decontam, fingerprint, langid, licenses, linededup, mixing, pii, queries, simhash, tokenids, toxicity

LONG = "long words here and there " * 20_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the bank of a river today", "en", "src1"),
    (1, "The quick brown fox jumps over the lazy dog near the bank of a river today", "en", "src1"),
    (1, "another text of one id", None, "src1"),
    (None, "Released under the MIT License by a@b.org", "en", None),
    (None, None, None, None),
    (4, None, "en", "src2"),
    (5, "", "de", "src2"),
    (6, " \n\t\n ", "de", ""),
    (7, LONG, "fr", "src9"),
    (8, "İstanbul \U0001f600 é É J̌ 漢字かな", "xx", "src9"),
    (9, "1 2 3", "en", "src8"),
    (-10, "x", "es", "src8"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for c in ("key", "fp", "row", "score", "_bucket", "n", "component_id", "size", "d", "pos", "term", "copies", "epochs"):
        df = df.withColumn(c, F.lit("clash"))
    return df


BENCHMARK = [(1, "the lazy dog near the bank of a river today"), (1, "the lazy dog near the bank of a river today"), (2, None), (3, ""), (None, "quick brown fox jumps"), (5, "x"), (6, "no such words")]
LABELS = [(1, 1), (1, 0), (None, 1), (5, None), (7, 0), (9, 0), (-10, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def test_fingerprint(spark, docs, empty):
    rows = fingerprint.edited_fingerprints(docs).collect()
    assert len(rows) == len(ROWS) and fingerprint.edited_fingerprints(empty).count() == 0
    texts = {(r.doc_id, r.n_chars): r for r in rows}
    assert texts[(None, 0)].fingerprint == texts[(4, 0)].fingerprint == fingerprint.digest(b"")
    assert texts[(6, 5)].fingerprint == fingerprint.digest(b"") and texts[(-10, 1)].near_edited == 1
    groups = fingerprint.exact_groups(docs).collect()
    assert len(groups) == len(ROWS) and len({r.fingerprint for r in groups}) == 8
    one = frame(spark, [(3, "abcd", "en", "s")])
    assert fingerprint.edited_fingerprints(one).first().edited_fingerprint == fingerprint.digest(b"abab")


def test_collisions_are_told_apart(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b"), (2, "A  b"), (3, "c")], "doc_id long, text string")
    monkeypatch.setattr(fingerprint, "digest", lambda canon: "same")
    found = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()}
    assert found == {1: "same-1", 2: "same-1", 3: "same-2"} or found == {1: "same-2", 2: "same-2", 3: "same-1"}


def test_pii(spark, docs, empty):
    rows = pii.anonymized(docs, "secret").collect()
    assert len(rows) == len(ROWS) and pii.anonymized(empty, "s").count() == 0
    assert [r.n_entities for r in rows if r.doc_id is None and r.text] == [1] and sum(r.text is None for r in rows) == 2
    assert not any("a@b.org" in (r.text or "") for r in rows)


def test_licenses(spark, docs, empty):
    rows = licenses.licenses(docs).collect()
    assert [(r.doc_id, r.license, r.first_word, r.last_word) for r in rows] == [(None, "MIT", 0, 4)] and licenses.licenses(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.licenses(docs, {"short": ["too few words"]})


def test_langid(spark, docs, empty):
    model = langid.train(docs)
    rows = langid.predict(docs, model).collect()
    assert len(rows) == len(ROWS) and langid.train(empty) is None and langid.predict(empty, None).count() == 0
    assert sum(r.lang_pred == "und" for r in rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame(LABELS, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.train(empty, labels)["bias"] == 0 and toxicity.train(docs, labels.limit(0))["bias"] == 0
    assert toxicity.nontoxic(docs, model).columns == docs.columns and toxicity.nontoxic(empty, model).count() == 0


def test_simhash(spark, docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS) and simhash.near_duplicates(empty).count() == 0
    assert {r.component_id for r in rows if r.fp == 0} == {4}
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == 8 and simhash.deduplicated(empty).count() == 0
    only = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")).collect()
    assert [r.component_id for r in only] == [None, None]


def test_linededup(spark, docs, empty):
    rows = linededup.deduplicated(docs).collect()
    assert len(rows) == len(ROWS) and linededup.deduplicated(empty).count() == 0
    assert sum(r.text is None for r in rows) == 2 and next(r for r in rows if r.doc_id == 6).n_lines == 3
    more = spark.createDataFrame([(1, "same line here\n\nother\nsame line here"), (2, "SAME line here "), (2, "SAME line here ")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in linededup.deduplicated(more).collect()) == [(1, "same line here\n\nother", 1), (2, "", 1), (2, "", 1)]


def test_tokenids(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    _, rows = tokenids.written_tokens(docs, queries.word_tokens(), queries.END_ID, queries.MOST_ID)
    rows = sorted(rows.collect(), key=lambda r: r.start)
    full = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    want = sorted((r[0] is not None, r[0] or 0, [*full.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in ROWS)
    import numpy as np

    assert sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()] and [r.doc_id for r in rows][2:] == sorted(r[0] for r in ROWS if r[0] is not None)
    _, none = tokenids.written_tokens(empty, queries.word_tokens(), queries.END_ID, queries.MOST_ID)
    assert none.count() == 0


def test_mixing(spark, docs, empty):
    args = (queries.domain_of(F.col("source")), queries.WEIGHTS, 6, 10, 2, 42)
    out = mixing.mixture(docs, *args)
    assert out.columns == docs.columns and out.count() > 0 and mixing.mixture(empty, *args).count() == 0
    rows = mixing.measured(docs, args[0])
    assert mixing.mix(rows, mixing.plan(rows, *args[1:]), 42).count() == len(ROWS)


def test_decontam(spark, docs, empty):
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    rows = decontam.contamination(docs, benchmark).collect()
    found = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows if r.contaminated)
    assert len(rows) == len(ROWS) and found == [(-10, 1, 1, ("5",)), (1, 16, 14, ("", "1")), (1, 16, 14, ("", "1"))]
    assert decontam.decontaminated(docs, benchmark).count() == len(ROWS) - 3 and decontam.contamination(empty, benchmark).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(docs, benchmark.limit(0)).collect())
    near = spark.createDataFrame([(1, "one two extra three four five")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    assert not decontam.contamination(near, item).first().contaminated and decontam.contamination(near, item, slop=1).first().contaminated


def test_stages(spark, docs, empty, tmp_path):
    spark.createDataFrame(LABELS, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, empty):
        now = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{start is docs}")
            stage(spark, now, str(tmp_path)).write.parquet(path)
            now = spark.read.schema(now.schema if k < 4 else "doc_id long, start long, n_tokens long, ids_crc32 long").parquet(path)
            assert k == 4 or now.columns == docs.columns


def test_no_local_folder_on_a_cluster():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpoint_root(SimpleNamespace(conf={}, sparkContext=context))
