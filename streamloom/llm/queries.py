"""The registered queries: each operator, with production parameters, over its whole table, in the columns its contract names."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprint, langid, licenses, linededup, mixing, pii, simhash, tokenids, toxicity
from .common import held_out, table

#: The tokenizer of op8, the id that ends a document, and the greatest id.
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MOST_ID = 49407


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


#: Where a session holds the key of op2's surrogates. Without one each run has a key of its own, and nobody can tell its surrogates again.
PII_SECRET = "spark.streamloom.pii.secret"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = spark.conf.get(PII_SECRET, None) or secrets.token_hex(32)
    return pii.anonymized(table(spark, sf_dir, "documents"), secret)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "template", "first_word", "last_word", "containment")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def word_tokens(path: str | None = None, cache_words: int = tokenids.CACHE_WORDS):
    """Makes the encoder of op8 on the worker that runs it."""

    def make():
        import public_tokenizers

        return tokenids.word_encoder(path or public_tokenizers.path(TOKENIZER), cache_words)

    return make


def op8_tokenids(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = tokenids.written_tokens(table(spark, sf_dir, "documents"), word_tokens(), END_ID, MOST_ID)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: The mixture of op9: which domain a source belongs to, by the last character of its name; whole-number weights (1 where none is named).
DOMAINS = {"web": "01234", "books": "567", "code": "89"}
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 1, "other": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 3}}
#: Share of all tokens, and how often a document may come.
BUDGET, EPOCHS, SEED = (6, 10), 2, 42


def domain_of(source: Column) -> Column:
    out, last = F.lit("other"), F.substring(source, -1, 1)
    for name, ends in DOMAINS.items():
        out = F.when(last.isin(*ends), name).otherwise(out)
    return out


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.measured(table(spark, sf_dir, "documents"), domain_of(F.col("source")))
    planned = mixing.plan(rows, WEIGHTS, *BUDGET, EPOCHS, SEED)
    return mixing.mix(rows, planned, SEED).select("doc_id", "domain", "lang", "source", "n_tokens", "budget", "copies")


def _share_sql(nodes: str, parent: str, name: str) -> str:
    """The children's parts of a budget, as mixing.share describes; nodes has cap, weight and budget."""
    order = f"partition by {parent} order by cap / weight, {name}"
    return f"""(select *, case when f then cap else (upto * rest) // greatest(open, 1) - ((upto - weight) * rest) // greatest(open, 1) end as got from (
      select *, budget - sum(case when f then cap else 0 end) over (partition by {parent}) as rest, sum(case when f then 0 else weight end) over (partition by {parent}) as open,
             sum(case when f then 0 else weight end) over ({order} rows between unbounded preceding and current row) as upto from (
        select *, cap * sum(weight) over ({order} rows between current row and unbounded following)
                  <= weight * (budget - coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0)) as f from {nodes})))"""


def _weight_sql(level: str) -> str:
    return "case " + "".join(f"when {level} = '{k}' then {v} " for k, v in WEIGHTS[level].items()) + "else 1 end"


_DOMAIN_SQL = "case " + "".join(f"when right(source, 1) in ({', '.join(repr(c) for c in ends)}) then '{k}' " for k, ends in DOMAINS.items()) + "else 'other' end"

OP9_SQL = rf"""
with d as (select doc_id, {_DOMAIN_SQL} as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens from documents),
leaf as (select domain, lang, source, sum(n_tokens) as tokens, sum(n_tokens) * {EPOCHS} as cap from d group by all),
l1 as (select domain, got from {_share_sql(f"(select domain, sum(cap) as cap, {_weight_sql('domain')} as weight, (select least(sum(tokens) * {BUDGET[0]} // {BUDGET[1]}, sum(cap)) from leaf) as budget from leaf group by domain)", "1", "domain")}),
l2 as (select domain, lang, got from {_share_sql(f"(select leaf.domain, lang, sum(cap) as cap, {_weight_sql('lang')} as weight, any_value(got) as budget from leaf join l1 using (domain) group by leaf.domain, lang)", "domain", "lang")}),
l3 as (select domain, lang, source, tokens, got from {_share_sql(f"(select domain, lang, source, tokens, cap, {_weight_sql('source')} as weight, got as budget from leaf join l2 using (domain, lang))", "domain, lang", "source")}),
want as (select *, case when tokens > 0 then got // tokens else 0 end as whole from l3),
o as (select d.*, got, whole, got - whole * tokens as rest, md5(concat_ws('|', '{SEED}', whole::bigint::varchar, doc_id::varchar)) as o from d join want using (domain, lang, source)),
c as (select *, sum(n_tokens) over (partition by domain, lang, source order by o, doc_id) as upto from o)
select doc_id, domain, lang, source, n_tokens, got::bigint as budget, (whole + case when rest > 0 and upto <= rest then 1 else 0 end)::bigint as copies from c
"""


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


OP10_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
win as (select distinct item_id, least(10, len(ws)) as n, array_to_string(ws[i : i + 9], ' ') as w
        from (select *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from b where len(ws) > 0)),
lens as (select distinct n from win),
spots as (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as w
       from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, lens where len(ws) >= n)),
hit as (select doc_id, spots.n, i, item_id from spots join win using (n, w)),
cover as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hit)) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join cover using (doc_id) left join items using (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_pii": op2_pii,
    "op3_licenses": op3_licenses,
    "op4_langid": op4_langid,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_linededup": op7_linededup,
    "op8_tokenids": op8_tokenids,
    "op9_mixing": op9_mixing,
    "op10_decontam": op10_decontam,
}

ORACLES: dict[str, str] = {
    "op9_mixing": OP9_SQL,
    "op10_decontam": OP10_SQL,
}
