"""Mixing sources to target weights, in DataFrame operations only.

A budget of tokens flows down a tree of domains, languages and sources. At each node the children share what the node gets by
their weights; a child that cannot use its share (its subtree has too few tokens, over all allowed epochs) leaves the rest to
its siblings, and only what a whole subtree cannot use reaches its ancestors. Each leaf then takes the longest
prefix, within its budget, of its documents in seeded order, epoch after epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_key

LEVELS = ["domain", "lang", "source"]
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that share a step of the prefix sums, on average.
STEP_ROWS = 4096
#: Leaves that are broadcast; more are joined by shuffles.
BROADCAST_LEAVES = 50_000


def _weight(level: str, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """`nodes` (parent columns, name, cap, weight over 0, budget of the parent at most the sum of caps) with `got`: whole tokens that add up to the budget.

    In order of cap per weight, children are full as long as their share of what is left reaches their cap; the rest share by weight.
    """
    order = Window.partitionBy(*parent, F.lit(0)).orderBy(F.col("cap") / F.col("weight"), name)
    up_to, all_of = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = nodes.withColumn("full", F.col("cap") * left <= F.col("weight") * (F.col("budget") - before))
    open_weight = F.when(F.col("full"), 0).otherwise(F.col("weight"))
    rest = full.withColumns(
        {
            "rest": F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_of),
            "open": F.sum(open_weight).over(all_of),
            "upto": F.sum(open_weight).over(up_to),
        }
    )
    got = F.expr("if(full, cap, (upto * rest) div open - ((upto - weight) * rest) div open)")
    return rest.select(*nodes.columns, got.alias("got"))


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], default: int, numerator: int, denominator: int, epochs: int) -> DataFrame:
    """`leaves` (domain, lang, source, tokens) with `got`: the budget of each leaf, out of numerator/denominator of all tokens. A leaf below a weight of 0 gets none."""
    weighted = leaves.withColumns({f"w_{x}": _weight(x, weights.get(x, {}), default) for x in LEVELS})
    usable = weighted.filter(" and ".join(f"w_{x} > 0" for x in LEVELS)).withColumn("cap", F.col("tokens") * epochs)
    target = leaves.agg(F.expr(f"cast(sum(tokens) * {numerator} div {denominator} as long)").alias("target"))
    sub = [usable.groupBy(*LEVELS[: k + 1], *(f"w_{x}" for x in LEVELS[: k + 1])).agg(F.sum("cap").alias("cap")) for k in range(3)]
    top = sub[0].crossJoin(F.broadcast(target))  # one row
    everything = Window.partitionBy(F.lit(0))
    top = top.withColumn("budget", F.least("target", F.sum("cap").over(everything))).withColumn("weight", F.col("w_domain"))
    got = share(top.select("domain", "cap", "weight", "budget"), [], "domain").select("domain", F.col("got").alias("budget"))
    for k in (1, 2):
        nodes = sub[k].withColumn("weight", F.col(f"w_{LEVELS[k]}")).select(*LEVELS[: k + 1], "cap", "weight").join(got, LEVELS[:k])
        got = share(nodes, LEVELS[:k], LEVELS[k]).select(*LEVELS[: k + 1], F.col("got").alias("budget"))
    return leaves.join(got, LEVELS, "left").select(*LEVELS, "tokens", F.coalesce("budget", F.lit(0)).alias("got"))


def _order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def measured(docs: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", whole_rows: bool = False) -> DataFrame:
    """(doc_id, key, domain, lang, source, n_tokens), with `whole_rows` also `row`, a struct of all columns: tokens are words between white space; null names are empty, a null text has none."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        row_key(F.col(text_col)).alias("key"),
        named(domain).alias("domain"),
        named(F.col(lang_col)).alias("lang"),
        named(F.col(source_col)).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
        *([F.struct("*").alias("row")] if whole_rows else []),
    )


def plan(rows: DataFrame, weights: dict[str, dict[str, int]], numerator: int, denominator: int, epochs: int, seed: int, default: int = 1) -> DataFrame:
    """(domain, lang, source, budget, epochs, cut): each leaf's budget, its whole epochs, and the last row of the part of an epoch after them (null: no row).

    Prefix sums run over steps of about STEP_ROWS rows each, found by their place in the seeded order: a leaf with a third of all rows
    is as many steps. Equal rows are taken together or not at all.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    leaves = materialize(leaves, "leaves")
    shares = budgets(leaves.select(*LEVELS, "tokens"), weights, default, numerator, denominator, epochs)
    whole = F.expr("if(tokens > 0, got div tokens, 0)")
    wanted = shares.select(*LEVELS, F.col("got").alias("budget"), whole.alias("epochs"), (F.col("got") - whole * F.col("tokens")).alias("rest"))
    wanted = materialize(wanted.join(leaves.select(*LEVELS, "n"), LEVELS), "budgets")
    few = wanted.count() <= BROADCAST_LEAVES
    ask = F.broadcast(wanted) if few else wanted
    keyed = rows.join(ask.filter("rest > 0"), LEVELS).withColumn("o", _order_key(seed, F.col("epochs"), F.col("doc_id")))
    steps = F.ceil(F.col("n") / STEP_ROWS)
    place = F.conv(F.substring("o", 1, 8), 16, 10).cast("long")
    keyed = keyed.withColumn("step", F.floor(place * steps / F.lit(1 << 32)).cast("long"))
    keyed = materialize(keyed.select(*LEVELS, "doc_id", "key", "n_tokens", "rest", "o", "step"), "steps")
    by_step = keyed.groupBy(*LEVELS, "step").agg(F.sum("n_tokens").alias("t"))
    ahead = Window.partitionBy(*LEVELS).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    base = by_step.select(*LEVELS, "step", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy(*LEVELS, "step").orderBy("o", "doc_id", "key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = keyed.join(base, [*LEVELS, "step"]).withColumn("upto", F.col("base") + F.sum("n_tokens").over(within))
    cuts = so_far.filter("upto <= rest").groupBy(*LEVELS).agg(F.max(F.struct("o", "doc_id", "key")).alias("cut"))
    return materialize(wanted.join(cuts, LEVELS, "left").select(*LEVELS, "budget", "epochs", "cut"), "mix-plan")


def mix(rows: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """`rows` (of `measured`, other columns stay) with `budget` of its leaf and `copies`: how often the mixture holds the row, 0 or more. No row moves but for a join on the leaf."""
    p = planned.select(*LEVELS, "budget", "epochs", "cut")
    few = planned.count() <= BROADCAST_LEAVES
    joined = rows.join(F.broadcast(p) if few else p, LEVELS)
    me = F.struct(_order_key(seed, F.col("epochs"), F.col("doc_id")).alias("o"), F.col("doc_id"), F.col("key"))
    extra = F.coalesce((me <= F.col("cut")).cast("long"), F.lit(0))
    return joined.select(*rows.columns, "budget", (F.col("epochs") + extra).alias("copies"))


def mixture(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], numerator: int, denominator: int, epochs: int, seed: int) -> DataFrame:
    """The mixture itself: rows of `docs`, all columns, each as often as the mixture holds it."""
    planned = plan(measured(docs, domain), weights, numerator, denominator, epochs, seed)
    chosen = mix(measured(docs, domain, whole_rows=True), planned, seed).filter("copies > 0")
    repeated = chosen.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
