"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index is a table of postings (doc, row key, term, position) for the terms that occur in the test windows. Each window is
looked up from its rarest term: a posting at p is a candidate start p - offset; candidates are intersected with the second
rarest term's offset-adjusted postings, and the few that stay with those of all other terms. With `slop` 0 these are
exact phrase matches, else proximity matches: a window matches at a start if each of its terms has a position within `slop` of its place. Any
start counts from which that holds, up to `slop` before the text, whichever term is rarest; hit are the positions themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_key, split_by_keys, without_keys

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of test terms that are broadcast; a larger test set is joined by shuffles.
BROADCAST_ROWS = 200_000
#: The term ids of a document's end mark (its position is the number of words), for rows with and without an id.
END, END_NULL = -1, -2
DOC = ["d", "key"]


def words(text: Column) -> Column:
    """A-Z lower-cased, then maximal runs of digits, a-z and non-ASCII; null has none."""
    found = F.regexp_extract_all(F.translate(text.cast("string"), UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def test_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(wid, terms, items): different windows of consecutive words; an item with fewer words is one, one without words none."""
    w, n = F.col("w"), F.size("w")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))), lambda i: F.slice(w, i, window))
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w"))
    cuts = rows.filter(n > 0).select("item", F.explode(cut).alias("terms"))
    found = cuts.groupBy("terms").agg(F.collect_set("item").alias("items"))
    return materialize(found.select(F.monotonically_increasing_id().alias("wid"), "terms", "items"), "windows")


def build_index(docs: DataFrame, vocabulary: DataFrame, terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings (d, key, term, pos) of the vocabulary (word, term), with an end mark for each row of `docs`. Written once; its terms are not shuffled."""
    doc_id = F.col(id_col).cast("long")
    marks = vocabulary.sparkSession.createDataFrame([("\x01", END), ("\x02", END_NULL)], "word string, term long")
    rows = docs.select(
        F.coalesce(doc_id, F.lit(0)).alias("d"),
        row_key(F.col(text_col)).alias("key"),
        F.posexplode(F.array_append(words(F.col(text_col)), F.when(doc_id.isNull(), "\x02").otherwise("\x01"))).alias("pos", "word"),
    )
    known = _small(vocabulary.select("word", "term").unionAll(marks), terms)
    return materialize(rows.join(known, "word").select("d", "key", "term", "pos"), "postings")


def _follow(wanted: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """The different rows of `wanted` (d, key, term, at, ...) with a posting of the term within `slop` of `at`."""
    if not slop:
        there = postings.select("d", "key", "term", F.col("pos").alias("at")).distinct()
        return wanted.join(there, [*DOC, "term", "at"], "left_semi")
    width = 2 * slop + 1
    bucket = lambda c: F.floor(c / width)
    near = F.array_distinct(F.array(bucket(F.col("at") - slop), bucket(F.col("at") + slop)))
    there = postings.select("d", "key", "term", "pos", bucket(F.col("pos")).alias("b")).distinct()
    hit = wanted.withColumn("b", F.explode(near)).join(there, [*DOC, "term", "b"]).filter(F.abs(F.col("pos") - F.col("at")) <= slop)
    return hit.select(*wanted.columns).distinct()


def matches(index: DataFrame, windows: DataFrame, vocabulary: DataFrame, slop: int = 0) -> DataFrame:
    """(d, key, wid, start, n): each occurrence of a window of n words at word `start` of a document."""
    counts = materialize(index.filter("term >= 0").groupBy("term").agg(F.count(F.lit(1)).alias("c")), "counts")
    spelled = windows.select("wid", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "word"))
    rank = F.row_number().over(Window.partitionBy("wid").orderBy("c", "off"))
    known = Window.partitionBy("wid")
    plan = materialize(
        spelled.join(vocabulary, "word")
        .join(counts, "term")
        .select("wid", "n", "off", "term", rank.alias("rank"), F.count(F.lit(1)).over(known).alias("have"))
        .filter("have = n")
        .drop("have"),
        "plan",
    )
    rows = plan.count()
    step = lambda cond: _small(plan.filter(cond).select("wid", "n", "off", "term"), rows)
    begin = F.col("pos") - F.col("off")
    starts = F.explode(F.sequence(begin - slop, begin + slop)) if slop else begin
    seeds = index.join(step("rank = 1"), "term").select(*DOC, "wid", "n", starts.alias("start")).distinct()
    seeds = materialize(seeds.filter(F.col("start") >= -slop), "seeds")

    def expect(found: DataFrame, cond: str) -> DataFrame:
        return found.join(step(cond).drop("n"), "wid").select(*DOC, "wid", "n", "start", "off", "term", (F.col("start") + F.col("off")).alias("at"))

    second = index.join(step("rank = 2").select("term").distinct(), "term", "left_semi")
    pairs = materialize(_follow(expect(seeds.filter("n > 1"), "rank = 2"), second, slop).select(*DOC, "wid", "n", "start").distinct(), "pairs")
    inside = split_by_keys(index.filter("term >= 0"), pairs, DOC)[0]  # only postings of documents that may hold a pair are shuffled
    rest = _follow(expect(pairs.filter("n > 2"), "rank > 2"), inside, slop)
    full = rest.groupBy(*DOC, "wid", "start", "n").agg(F.count(F.lit(1)).alias("c")).filter("c = n - 2").drop("c")
    cols = [*DOC, "wid", "start", "n"]
    return full.select(cols).unionAll(pairs.filter("n = 2").select(cols)).unionAll(seeds.filter("n = 1").select(cols))


def _hit_spans(found: DataFrame) -> DataFrame:
    """(d, key, n_hit) of exact matches: words that any of them spans."""
    end = F.col("start") + F.col("n")
    before = F.max(end).over(Window.partitionBy(*DOC).orderBy("start", "n", "wid").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(before, F.lit(0))))
    return found.select(*DOC, new.alias("new")).groupBy(*DOC).agg(F.sum("new").alias("n_hit"))


def _hit_places(found: DataFrame, index: DataFrame, windows: DataFrame, vocabulary: DataFrame, slop: int) -> DataFrame:
    """(d, key, n_hit) of proximity matches: positions of a match's terms within `slop` of their places."""
    width = 2 * slop + 1
    terms = windows.select("wid", F.posexplode("terms").alias("off", "word")).join(vocabulary, "word").select("wid", "off", "term")
    at = found.join(terms, "wid").select(*DOC, "term", (F.col("start") + F.col("off")).alias("at")).distinct()
    bucket = lambda c: F.floor(c / width)
    near = at.withColumn("b", F.explode(F.array_distinct(F.array(bucket(F.col("at") - slop), bucket(F.col("at") + slop)))))
    there = split_by_keys(index.filter("term >= 0"), found.select(*DOC).distinct(), DOC)[0].withColumn("b", bucket(F.col("pos")))
    hit = near.join(there, [*DOC, "term", "b"]).filter(F.abs(F.col("pos") - F.col("at")) <= slop)
    return hit.select(*DOC, "pos").distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(doc_id, key, n_words, n_hit, n_items, items, contaminated): a row per row of `docs`.

    Null and empty texts have no words and are clean. Rows that share an id but not a text are told apart by `key` (row_key);
    equal rows get equal results. Items with equal ids are one item; a null item id counts as the id "". An empty benchmark hits nothing.
    """
    windows = test_windows(benchmark, text_col=text_col, window=window)
    vocabulary = materialize(
        windows.select(F.explode("terms").alias("word")).distinct().select("word", F.monotonically_increasing_id().alias("term")), "vocabulary"
    )
    index = build_index(docs, vocabulary, vocabulary.count(), id_col, text_col)
    found = materialize(matches(index, windows, vocabulary, slop), "matches")
    hits = _hit_places(found, index, windows, vocabulary, slop) if slop else _hit_spans(found)
    items = (
        found.select(*DOC, "wid").distinct().join(windows.select("wid", F.explode("items").alias("item")), "wid")
        .groupBy(*DOC)
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    hit = hits.join(items, DOC)
    out = index.filter("term < 0").join(hit, DOC, "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.when(F.col("term") == END, F.col("d")).alias("doc_id"),
        "key",
        F.col("pos").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, in which no window of `benchmark` occurs."""
    found = materialize(contamination(docs, benchmark, id_col, text_col).filter("contaminated").select("doc_id", "key"), "contaminated")
    return without_keys(docs, found, id_col, text_col)
