"""License scans, in DataFrame operations only: MinHash over overlapping text windows retrieves templates, exact shingle containment verifies them.

Texts and templates are sequences of words (runs of letters and digits, in lower case) and of the shingles of SHINGLE words that
begin at each word. A window is WINDOW consecutive shingles; windows begin at every shingle, in texts and templates. Its signature is the least value of each of HASHES hash functions;
every function is a band of one row, so windows that share half of their shingles collide with probability 1 - 0.5^HASHES (0.98), and equal ones for certain.

That settles what a match needs: of a template of n shingles at least CONTAINED stand in the text. Of 2 to 4 shingles that is all of them, of 5 or more at least four in five, so two
neighbours stand unbroken, which is an equal window: such a template is retrieved for certain. A template of one shingle lies in WINDOW windows of the text, and is missed by all with
probability 0.5^(HASHES * WINDOW), 0.0002, at most. Longer windows would lose the one-sentence wordings by which texts name licenses.

Texts with a collision are verified, word by word: a match is a place where at least CONTAINED of a template's shingles stand, each in its place give or take SLACK of the
template's length, and each word that tells the license from its kin (TELLING) stands in one of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, row_key

SHINGLE = 5
WINDOW = 2
HASHES = 6
CONTAINED = 0.8
#: By how much of the template's length words added or left out may move its shingles.
SLACK = 0.25
WORD = r"[\p{L}\p{N}]+"
#: Template shingles that are broadcast, and signatures held in an expression; more are refused.
MAX_TEMPLATE_SHINGLES = 100_000

DOC = ["doc_id", "key"]

# The wordings by which texts name a public license, or the license's own opening words.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "AGPL-3.0": [
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    # the clause that both BSD licenses begin with, and the one that only the longer has
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-2.1": [
        "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ],
    "LGPL-3.0": [
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
_SPDX = "AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-NC-4.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense".split()
#: Notices of any length, also under SHINGLE words, that count only word for word.
NOTICES = {
    "All-Rights-Reserved": ["All rights reserved"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
} | {f"{name} (SPDX)": [f"SPDX-License-Identifier: {name}"] for name in _SPDX}
#: Template words that tell a license from its kin: a match needs each, with the word after it, in a shingle that matches.
TELLING = r"[0-9]|^(gnu|lesser|affero|library)$"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _zipped(df: DataFrame, out: str, left: str, right: str, skip: int) -> DataFrame:
    """Column `out`: a hash of each element of `left` with the element `skip` places on in `right`; as long as there are such elements.

    Arrays that a lambda needs must be columns of their own, or each call computes them anew.
    """
    n = F.greatest(F.size(right) - skip, F.lit(0))
    return df.withColumn(out, F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(skip + 1), n), lambda x, y: F.xxhash64(x, y)))


def shingle_hashes(df: DataFrame, text: str) -> DataFrame:
    """`df` with `w`, the words of column `text`, and `hs`, a hash for each shingle of them; fewer words than a shingle has give no shingle."""
    found = df.withColumn("w", F.coalesce(words(F.col(text)), F.array().cast("array<string>")))
    found = found.withColumn("w1", F.transform("w", lambda x: F.xxhash64(x)))
    two = _zipped(found, "w2", "w1", "w1", 1)
    four = _zipped(two, "w4", "w2", "w2", 2)
    return _zipped(four, "hs", "w4", "w1", 4).drop("w1", "w2", "w4")


def signature(hashes: Column, k: int) -> Column:
    """The least value of the k-th hash function over each window of two shingles; a single shingle is a window."""
    each = F.transform(hashes, lambda x: F.xxhash64(F.lit(k), x))
    more = F.transform(F.slice(hashes, 2, 1 << 30), lambda x: F.xxhash64(F.lit(k), x))
    n = F.greatest(F.size(hashes) - WINDOW + 1, F.lit(1))
    return F.slice(F.zip_with(each, more, lambda x, y: F.least(x, y)), F.lit(1), n)


def template_shingles(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """(template, license, at, h, total): the shingles of each template; one shorter than a shingle is refused."""
    rows = [(k, name, t) for k, (name, t) in enumerate((name, t) for name, ts in templates.items() for t in ts)]
    spelled = spark.createDataFrame(rows, "template int, license string, text string")
    short = spelled.filter(F.size(words(F.col("text"))) < SHINGLE).count()
    if short:
        raise ValueError(f"{short} templates have under {SHINGLE} words")
    spelled = spelled.withColumn("w", words(F.col("text")))
    told = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get(F.col("w"), i).rlike(TELLING))
    hashed = shingle_hashes(spelled.withColumn("told", told), "text")
    cut = hashed.select("template", "license", F.posexplode("hs").alias("at", "h"), F.size("hs").alias("total"), "hs", "told", "w")
    cut = cut.withColumn("said", F.slice("w", F.col("at") + 1, F.lit(SHINGLE))).drop("w")
    return cut.withColumns({"tells": F.filter("told", lambda i: (i >= F.col("at")) & ((i < F.col("at") + SHINGLE - 1) | ((i == F.col("at") + SHINGLE - 1) & (F.col("at") + 1 == F.col("total"))))), "told": F.size("told")})


def noticed(rows: DataFrame, notices: dict[str, list[str]], number: int) -> DataFrame:
    """The places in `rows` (doc_id, key, text) where a notice stands word for word; `number` is the first notice's template number."""
    spelled = [(number + k, name, re.findall(r"[^\W_]+", t.lower())) for k, (name, t) in enumerate((name, t) for name, ts in notices.items() for t in ts)]
    gap = r"[^\p{L}\p{N}]+"
    some = rows.filter(F.lower("text").rlike("|".join(gap.join(w) for _, _, w in spelled)))
    listed = F.array(*(F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.array(*map(F.lit, w)).alias("phrase")) for k, name, w in spelled))
    each = some.distinct().withColumn("w", words(F.col("text"))).select(*DOC, "w", F.explode(listed).alias("t")).select(*DOC, "w", "t.*")
    spots = F.sequence(F.lit(0), F.greatest(F.size("w") - F.size("phrase"), F.lit(0)))
    first = F.filter(spots, lambda i: (F.get(F.col("w"), i) == F.get(F.col("phrase"), 0)) & (F.slice(F.col("w"), i + 1, F.size("phrase")) == F.col("phrase")))
    found = each.select(*DOC, "template", "license", F.size("phrase").alias("n"), F.explode(first).alias("at"))
    at = F.col("at").cast("long")
    return found.select(*DOC, "template", "license", at.alias("first_word"), (at + F.col("n") - 1).alias("last_word"), F.lit(1.0).alias("containment"))


def licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, key, template, license, first_word, last_word, containment): a row for each place where a template is matched.

    Places of one template that overlap are one, the best, and of equal ones the first. Null and empty texts match nothing. Wholly equal
    rows of `docs` have their matches once. `notices` must stand word for word; without `templates`, NOTICES are looked for.
    """
    spark = docs.sparkSession
    shingles = materialize(template_shingles(spark, templates or TEMPLATES), "templates")
    if shingles.count() > MAX_TEMPLATE_SHINGLES:
        raise ValueError(f"over {MAX_TEMPLATE_SHINGLES} template shingles")
    whole = shingles.select("template", "hs").distinct()
    wanted = whole.select(*(signature(F.col("hs"), k).alias(f"s{k}") for k in range(HASHES)))
    wanted = wanted.agg(*(F.array_distinct(F.flatten(F.collect_set(f"s{k}"))).alias(f"t{k}") for k in range(HASHES)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    hashed = shingle_hashes(rows, "text").select(*DOC, "hs", "w")
    probed = hashed.crossJoin(F.broadcast(wanted))  # one row: the bands of all templates
    hit = F.lit(False)
    for k in range(HASHES):
        hit = hit | F.arrays_overlap(signature(F.col("hs"), k), F.col(f"t{k}"))
    found = materialize(probed.filter(hit).select("doc_id", "key", "hs", "w").dropDuplicates(DOC), "retrieved")
    cut = F.transform("hs", lambda h, i: F.struct(i.alias("pos"), h.alias("h"), F.slice("w", i + 1, F.lit(SHINGLE)).alias("said")))
    place = found.select(*DOC, F.inline(cut)).join(F.broadcast(shingles.drop("hs")), ["h", "said"])  # MAX_TEMPLATE_SHINGLES bounds these
    # A shingle at `pos` that stands at `at` in the template says that a match begins at pos - at; words added or left out move that by up to
    # `room`. Of two rows of bins, each twice as wide, one has all of a match in one bin.
    room = F.floor(F.col("total") * SLACK)
    begin, wide = F.col("pos") - F.col("at"), 2 * room + 1
    bins = F.array(F.struct(F.lit(0).alias("row"), F.floor(begin / wide).alias("bin")), F.struct(F.lit(1).alias("row"), F.floor((begin + room) / wide).alias("bin")))
    binned = place.select(*DOC, "template", "license", "total", "told", "tells", "pos", "at", F.explode(bins).alias("b"))
    scored = binned.groupBy(*DOC, "template", "license", "total", "told", "b").agg(
        F.count_distinct("at").alias("n"), F.min("pos").alias("first_word"), (F.max("pos") + SHINGLE - 1).alias("last_word"), F.size(F.array_distinct(F.flatten(F.collect_list("tells")))).alias("tell")
    )
    full = scored.filter(F.col("n") >= CONTAINED * F.col("total")).filter("tell = told")
    order = Window.partitionBy(*DOC, "template").orderBy("first_word", "last_word", "b")
    ended = F.max("last_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("first_word") > ended, F.lit(True)).cast("int")
    islands = full.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    best = F.struct(F.col("n"), -F.col("first_word"), -F.col("last_word"))
    chosen = islands.groupBy(*DOC, "template", "license", "total", "island").agg(F.max(best).alias("x"))
    out = chosen.select(
        *DOC,
        "template",
        "license",
        (-F.col("x.col2")).cast("long").alias("first_word"),
        (-F.col("x.col3")).cast("long").alias("last_word"),
        (F.col("x.n") / F.col("total")).alias("containment"),
    )
    if notices is None and templates is None:
        notices = NOTICES
    return out.unionAll(noticed(rows, notices, sum(map(len, (templates or TEMPLATES).values())))) if notices else out
