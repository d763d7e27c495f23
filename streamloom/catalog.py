"""The registered queries of the engine and their SQL, over the test tables.

The stream is `events`, in order of (ts, event_id); its clicks and purchases are the two sides of stream joins; `customer` and `region` are reference tables.
Each query goes through the engine: text to plan to DataFrame. Float sums are exact decimals (two places) turned to double, so both sides give the same bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.types import infer_output_schema
from .operators.custom import deduplicated
from .operators.frames import events
from .plans.compiler import Environment, compile_query
from .plans.deployment import Windowing
from .plans.query import parse
from .sources import generators
from .sources.folders import shared_folder
from .sources.sinks import table_sink
from .sources.tables import ReferenceTables, SessionTables
from .streaming import live

HOUR = Windowing("tumbling", 1, "hours", "count", 1, exact_scale=2)


def _with(**changes) -> Windowing:
    from dataclasses import replace

    return replace(HOUR, **changes)


PER_WINDOW = _with(agg_state="window")
SLIDE_COUNT = _with(kind="sliding", velocity=5, agg_state="window")
SLIDE_TIME = _with(kind="sliding", velocity_type="time", velocity=7200, agg_state="window")
EARLY = _with(velocity=5, agg_state="window", tumbling_velocity=True)
STREAM = {"event_id": "INT", "ts": "TIMESTAMP", "user_id": "INT", "event_type": "STRING", "value": "FLOAT", "props": "STRING"}
CUSTOMER = {"c_custkey": "INT", "c_name": "STRING", "c_nationkey": "INT", "c_acctbal": "FLOAT", "c_mktsegment": "STRING"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def environment(spark: SparkSession, sf_dir: str, windowing: Windowing = HOUR) -> Environment:
    raw = _table(spark, sf_dir, "events")
    typed = raw.withColumn("__time", F.col("ts")).withColumn("ts", F.col("ts").cast("string"))
    stream = events(typed, "__time", "event_id").drop("__time")
    customer, region = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "region")
    keyed = customer.withColumnRenamed("c_custkey", "user_id")
    clicks, buys = stream.filter("event_type = 'click'"), stream.filter("event_type = 'purchase'")
    streams = {"events": stream, "clicks": clicks, "purchases": buys, "sparse": stream.withColumn("event_type", F.expr("nullif(event_type, 'click')"))}
    return Environment(streams, {"customer": customer, "region": region, "accounts": keyed}, windowing)


_Query = Callable[[SparkSession, str], DataFrame]


def _run(text: str, windowing: Windowing = HOUR) -> _Query:
    return lambda spark, sf_dir: compile_query(text, environment(spark, sf_dir, windowing))


def _renamed(query: _Query, *names: str) -> _Query:
    return lambda spark, sf_dir: query(spark, sf_dir).toDF(*names)


def _emitted(text: str, windowing: Windowing) -> _Query:
    """With the window or the firing event that a row belongs to."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = compile_query(text, environment(spark, sf_dir, windowing), keep_emit=True)
        return out.select(F.col("__emit.w").alias("emit_window"), F.col("__emit.s").alias("emit_seq"), *(F.col(f"`{c}`") for c in out.columns if c != "__emit"))

    return query


LIVE_FILES = 3


def _live(text: str, windowing: Windowing, *names: str) -> _Query:
    """The rows that a live query writes to a table: the events as files, a file a micro-batch, until all are read."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
        raw = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
        second = F.unix_micros("ts")
        cuts = raw.agg(F.percentile(second, [k / LIVE_FILES for k in range(1, LIVE_FILES)]).alias("cuts")).first()[0] or []
        part = sum(((second > c).cast("int") for c in cuts), F.lit(0))
        for k in range(LIVE_FILES):  # one after another: files are read in the order of their times
            raw.filter(part == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
        frame = live.arrived(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), "ts").drop("__tie0", "ts")
        frame = frame.withColumn("__tie0", F.col("event_id"))
        frames = {"events": frame, "clicks": frame.filter("event_type = 'click'"), "purchases": frame.filter("event_type = 'purchase'")}
        run = live.start(spark, parse(text), Environment(frames, {}, windowing), table_sink(f"{root}/out"), f"{root}/checkpoint", trigger={"availableNow": True})
        run.awaitTermination()
        out = spark.read.parquet(f"{root}/out").drop("batch")
        return out.toDF(*names) if names else out

    return query


def _own_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = environment(spark, sf_dir)
    env.streams["events"] = deduplicated("user_id", "event_type")(env.streams["events"])
    return compile_query("SELECT event_id, user_id, event_type, value FROM events WHERE value > 20", env)


def _routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = environment(spark, sf_dir)
    queries = {"large": "SELECT event_id, value FROM events WHERE value > 50", "clicks": 'SELECT event_id, value FROM events WHERE event_type = "click"'}
    parts = [compile_query(q, env).withColumn("query", F.lit(name)) for name, q in queries.items()]
    return parts[0].unionByName(parts[1])


def _nations(spark: SparkSession, sf_dir: str) -> ReferenceTables:
    """A reference table `nation` with the rows of the test table."""
    tables = ReferenceTables(spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}")
    tables.create_table("nation", [("n_nationkey", "INT"), ("n_name", "STRING"), ("n_regionkey", "INT")])
    tables.append("nation", _table(spark, sf_dir, "nation"))
    return tables


def _table_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _nations(spark, sf_dir)
    tables.insert_row("nation", {"n_nationkey": 100, "n_name": "ATLANTIS"})
    return tables.frame("nation")


def _table_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _nations(spark, sf_dir)
    tables.update_rows("nation", {"n_name": "SOMEWHERE"}, {"n_regionkey": 2})
    return tables.frame("nation")


def _table_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _nations(spark, sf_dir)
    tables.delete_rows("nation", {"n_regionkey": 3})
    return tables.frame("nation")


def _table_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _nations(spark, sf_dir)
    tables.add_column("nation", "note", "STRING")
    tables.insert_row("nation", {"n_nationkey": 101, "note": "new"})
    return tables.frame("nation")


def _table_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).frame("nation").orderBy("n_nationkey").limit(5)


def _table_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_nations(spark, sf_dir).table_schema("nation"), "name string, type string")


def _table_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _nations(spark, sf_dir)
    tables.create_table("a_region", [("r", "INT")])
    return spark.createDataFrame([(t,) for t in tables.list_tables()], "name string")


def _table_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = SessionTables(spark)
    tables.create_table("readings", {"sensor": "STRING", "v": "FLOAT", "n": "INT"})
    tables.insert("readings", {"sensor": "s1", "v": 1.5, "n": 1})
    tables.insert_batch("readings", [{"sensor": "s1", "v": 2.5, "n": 2}, {"sensor": "s2", "v": 4.0, "n": 3}])
    return tables.query("SELECT sensor, sum(v) AS total, max(n) AS latest FROM readings GROUP BY sensor ORDER BY sensor")


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = parse("SELECT user_id, c_name, COUNT(event_id), MAX(event_type) FROM events INNER JOIN customer ON user_id = c_custkey")
    return spark.createDataFrame(list(infer_output_schema(plan, STREAM, CUSTOMER, "table_").items()), "name string, type string")


def _generator(kind: str) -> _Query:
    return lambda spark, _: generators.generated(spark, kind, 1000, 1)


AGGS = "SELECT event_type, COUNT(value), SUM(value), AVG(value), MAX(value), MIN(value) FROM events"
AGG_NAMES = ("event_type", "n", "total", "mean", "most", "least")
FLUSH = _with(agg_state="window", flush_last=True, size=24 * 400)
FLAGSHIP = "SELECT event_type, COUNT(value), AVG(value), MAX(value) FROM events WHERE value > 50"

QUERIES: dict[str, _Query] = {
    "source_scan": _run("SELECT event_id, ts, user_id, event_type, value, props FROM events"),
    "routing_fanout": _routing,
    "filter_gt": _run("SELECT event_id, value FROM events WHERE value > 50"),
    "filter_lt": _run("SELECT event_id, value FROM events WHERE value < 50.5"),
    "filter_ge": _run("SELECT event_id, value FROM events WHERE value >= 50"),
    "filter_le": _run("SELECT event_id, value FROM events WHERE value <= 50"),
    "filter_eq_num": _run("SELECT event_id, user_id FROM events WHERE user_id = 5"),
    "filter_ne": _run("SELECT event_id, user_id FROM events WHERE user_id != 5"),
    "filter_eq_str": _run('SELECT event_id, event_type FROM events WHERE event_type = "click"'),
    "select_star": _run("SELECT * FROM events"),
    "project_columns": _run("SELECT value, event_id, event_type FROM events"),
    "project_missing": _run("SELECT event_id, humidity FROM events"),
    "group_without_agg": _run("SELECT event_type, user_id FROM events GROUP BY event_type"),
    "agg_count": _renamed(_run("SELECT event_type, COUNT(value) FROM events", FLUSH), "event_type", "n"),
    "agg_sum": _renamed(_run("SELECT event_type, SUM(value) FROM events", FLUSH), "event_type", "total"),
    "agg_avg": _renamed(_run("SELECT event_type, AVG(value) FROM events", FLUSH), "event_type", "mean"),
    "agg_max": _renamed(_run("SELECT event_type, MAX(value) FROM events", FLUSH), "event_type", "most"),
    "agg_min": _renamed(_run("SELECT event_type, MIN(value) FROM events", FLUSH), "event_type", "least"),
    "agg_multi": _renamed(_run(AGGS, FLUSH), *AGG_NAMES),
    "agg_global": _renamed(_run("SELECT COUNT(value), SUM(user_id), AVG(value) FROM events", FLUSH), "n", "users", "mean"),
    "agg_implicit_group": _renamed(_run("SELECT event_type, user_id, COUNT(event_id) FROM events", FLUSH), "event_type", "user_id", "n"),
    "agg_group_by": _renamed(_run("SELECT user_id, COUNT(event_id) FROM events GROUP BY user_id", FLUSH), "user_id", "n"),
    "agg_group_by_multi": _renamed(_run("SELECT user_id, event_type, SUM(value) FROM events GROUP BY user_id, event_type", FLUSH), "user_id", "event_type", "total"),
    "agg_hidden_key": _renamed(_run("SELECT COUNT(event_id), MAX(value) FROM events GROUP BY user_id", FLUSH), "n", "most"),
    "agg_bare_first": _renamed(_run("SELECT event_type, user_id, COUNT(event_id) FROM events GROUP BY event_type", FLUSH), "event_type", "first_user", "n"),
    "agg_skip_empty": _renamed(_run("SELECT event_type, SUM(humidity) FROM events", FLUSH), "event_type", "total"),
    "win_tumbling_agg": _renamed(_emitted(AGGS, PER_WINDOW), "w", "s", *AGG_NAMES),
    "win_tumbling_flush": _renamed(_emitted(AGGS, _with(agg_state="window", flush_last=True)), "w", "s", *AGG_NAMES),
    "win_unit_minutes": _renamed(_emitted(AGGS, _with(agg_state="window", size=90, unit="minutes")), "w", "s", *AGG_NAMES),
    "win_tumbling_cumulative": _renamed(_emitted(FLAGSHIP, HOUR), "w", "s", "event_type", "n", "mean", "most"),
    "win_tumbling_early_fire": _renamed(_emitted("SELECT event_type, COUNT(value), SUM(value) FROM events", EARLY), "w", "s", "event_type", "n", "total"),
    "win_sliding_count": _renamed(_emitted("SELECT event_type, COUNT(value), SUM(value) FROM events", SLIDE_COUNT), "w", "s", "event_type", "n", "total"),
    "win_sliding_time": _renamed(_emitted("SELECT event_type, COUNT(value), SUM(value) FROM events", SLIDE_TIME), "w", "s", "event_type", "n", "total"),
    "win_sliding_cumulative": _renamed(
        _emitted("SELECT event_type, COUNT(value), AVG(value), MIN(value) FROM events", _with(kind="sliding", velocity=5)), "w", "s", "event_type", "n", "mean", "least"
    ),
    "ss_join_tumbling_eq": _run("SELECT event_id, right_event_id FROM clicks INNER JOIN purchases ON user_id = user_id"),
    "ss_join_tumbling_ne": _run("SELECT event_id, right_event_id FROM clicks INNER JOIN purchases ON user_id != user_id"),
    "ss_join_sliding_eq": _run("SELECT event_id, right_event_id FROM clicks INNER JOIN purchases ON user_id = user_id", SLIDE_COUNT),
    "ss_join_sliding_ne": _run("SELECT event_id, right_event_id FROM clicks INNER JOIN purchases ON user_id != user_id", SLIDE_COUNT),
    "ss_join_collision": _run("SELECT * FROM clicks INNER JOIN purchases ON user_id = user_id", SLIDE_COUNT),
    "st_join_eq": _run("SELECT event_id, user_id, c_name, c_acctbal FROM events INNER JOIN customer ON user_id = c_custkey"),
    "st_join_ne": _run("SELECT event_id, r_name FROM events INNER JOIN region ON user_id != r_regionkey"),
    "st_join_collision": _run("SELECT event_id, user_id, table_user_id, c_name FROM events INNER JOIN accounts ON user_id = user_id"),
    "join_then_filter": _run('SELECT event_id, c_mktsegment, c_acctbal FROM events INNER JOIN customer ON user_id = c_custkey WHERE c_acctbal > 1000'),
    "join_then_agg": _renamed(
        _run("SELECT event_type, COUNT(event_id), AVG(value) FROM events INNER JOIN customer ON user_id = c_custkey WHERE c_acctbal > 0", FLUSH), "event_type", "n", "mean"
    ),
    "agg_null_key": _renamed(_run("SELECT event_type, COUNT(value), MIN(value) FROM sparse", FLUSH), "event_type", "n", "least"),
    "ss_self_join": _run("SELECT event_id, right_event_id FROM clicks INNER JOIN clicks ON user_id = user_id", SLIDE_COUNT),
    "own_operator": _own_operator,
    "live_filter_sink": _live("SELECT event_id, value FROM events WHERE value > 50", HOUR),
    "live_tumbling": _live(AGGS, PER_WINDOW, *AGG_NAMES),
    "live_early_fire": _live("SELECT event_type, COUNT(value), SUM(value) FROM events", EARLY, "event_type", "n", "total"),
    "live_sliding_join": _live("SELECT event_id, right_event_id FROM clicks INNER JOIN purchases ON user_id = user_id", SLIDE_COUNT),
    "table_create_insert": _table_insert,
    "table_update": _table_update,
    "table_delete": _table_delete,
    "table_add_column": _table_add_column,
    "table_select_limit": _table_limit,
    "table_schema": _table_schema,
    "table_list": _table_list,
    "table_raw_sql": _table_sql,
    "infer_output_schema": _inferred,
    "gen_pollution": _generator("pollution"),
    "gen_weather": _generator("weather"),
    "gen_vehicle": _generator("vehicle"),
    "gen_signal": _generator("signal"),
}

_S = "with s as (select *, epoch_us(ts) as us, row_number() over (order by ts, event_id) as seq from events)"
_DEC = "cast(sum(cast({} as decimal(18, 2))) as double)"
_SUM, _MEAN = _DEC.format("value"), _DEC.format("value") + " / cast(count(value) as double)"
_B = _S + ", b as (select *, cast(floor((us - min(us) over ()) / {size}.0) as bigint) as w from s{where})"
_FULL = str((1 << 62) - 1)
_AGGS = f"count(value) as n, {_SUM} as total, {_MEAN} as mean, max(value) as most, min(value) as least"


def _simple(columns: str, rest: str = "") -> str:
    return f"select {columns} from events {rest}"


def _tumbling_join_sql(op: str) -> str:
    return f"""{_S}, u as (select *, cast(floor((us - min(us) over ()) / 3600000000.0) as bigint) as w from s where event_type in ('click', 'purchase'))
select l.event_id, r.event_id as right_event_id from u l join u r on l.w = r.w and l.user_id {op} r.user_id
where l.event_type = 'click' and r.event_type = 'purchase' and l.w < (select max(w) from u)"""


def _sliding_join_sql(columns: str, op: str) -> str:
    return f"""select {columns} from events l join events r on l.user_id {op} r.user_id and r.ts between l.ts - interval 1 hour and l.ts + interval 1 hour
where l.event_type = 'click' and r.event_type = 'purchase'"""


_TS = "strftime({}.ts, '%Y-%m-%d %H:%M:%S') || case when epoch_us({}.ts) % 1000000 = 0 then '' else rtrim('.' || lpad((epoch_us({}.ts) % 1000000)::varchar, 6, '0'), '0') end"
_STAR = f"event_id, {_TS.format('events', 'events', 'events')} as ts, user_id, event_type, value, props"
_SLIDE = _S + """, t as (select seq as tseq, us as tus from s where seq % 5 = 0),
e as (select t.tseq, s.* from t join s on s.seq <= t.tseq and s.us >= t.tus - 3600000000)"""

ORACLES: dict[str, str] = {
    "source_scan": _simple(_STAR),
    "routing_fanout": "select event_id, value, 'large' as query from events where value > 50 union all select event_id, value, 'clicks' from events where event_type = 'click'",
    "filter_gt": _simple("event_id, value", "where value > 50"),
    "filter_lt": _simple("event_id, value", "where value < 50.5"),
    "filter_ge": _simple("event_id, value", "where value >= 50"),
    "filter_le": _simple("event_id, value", "where value <= 50"),
    "filter_eq_num": _simple("event_id, user_id", "where user_id = 5"),
    "filter_ne": _simple("event_id, user_id", "where user_id <> 5"),
    "filter_eq_str": _simple("event_id, event_type", "where event_type = 'click'"),
    "select_star": _simple(_STAR),
    "project_columns": _simple("value, event_id, event_type"),
    "project_missing": _simple("event_id, cast(null as varchar) as humidity"),
    "group_without_agg": _simple("event_type, user_id"),
    "agg_count": _simple("event_type, count(value) as n", "group by event_type"),
    "agg_sum": _simple(f"event_type, {_SUM} as total", "group by event_type"),
    "agg_avg": _simple(f"event_type, {_MEAN} as mean", "group by event_type"),
    "agg_max": _simple("event_type, max(value) as most", "group by event_type"),
    "agg_min": _simple("event_type, min(value) as least", "group by event_type"),
    "agg_multi": _simple(f"event_type, {_AGGS}", "group by event_type"),
    "agg_global": _simple(f"count(value) as n, cast(sum(user_id) as bigint) as users, {_MEAN} as mean"),
    "agg_implicit_group": _simple("event_type, user_id, count(event_id) as n", "group by event_type, user_id"),
    "agg_group_by": _simple("user_id, count(event_id) as n", "group by user_id"),
    "agg_group_by_multi": _simple(f"user_id, event_type, {_SUM} as total", "group by user_id, event_type"),
    "agg_hidden_key": _simple("count(event_id) as n, max(value) as most", "group by user_id"),
    "agg_bare_first": f"{_S} select event_type, arg_min(user_id, seq) as first_user, count(event_id) as n from s group by event_type",
    "agg_skip_empty": "select event_type, cast(null as double) as total from events where false",
    "win_tumbling_agg": f"{_B.format(size=3600000000, where='')} select w, {_FULL} as s, event_type, {_AGGS} from b where w < (select max(w) from b) group by w, event_type",
    "win_tumbling_flush": f"{_B.format(size=3600000000, where='')} select w, {_FULL} as s, event_type, {_AGGS} from b group by w, event_type",
    "win_unit_minutes": f"{_B.format(size=5400000000, where='')} select w, {_FULL} as s, event_type, {_AGGS} from b where w < (select max(w) from b) group by w, event_type",
    "win_tumbling_cumulative": f"""{_B.format(size=3600000000, where=' where value > 50')},
p as (select w, event_type, count(value) as c, sum(cast(value as decimal(18, 2))) as v, max(value) as m from b where w < (select max(w) from b) group by w, event_type)
select w, {_FULL} as s, event_type, cast(sum(c) over g as bigint) as n, cast(sum(v) over g as double) / cast(sum(c) over g as double) as mean, max(m) over g as most
from p window g as (partition by event_type order by w rows between unbounded preceding and current row)""",
    "win_tumbling_early_fire": f"""{_B.format(size=3600000000, where='')}, k as (select *, row_number() over (partition by w order by seq) as nth from b),
e as (select k.w, {_FULL} as s, event_type, value from k where w < (select max(w) from k)
      union all select t.w, t.seq, k.event_type, k.value from k join k t on t.w = k.w and t.nth % 5 = 0 and k.seq <= t.seq)
select w, s, event_type, count(value) as n, {_SUM} as total from e group by w, s, event_type""",
    "win_sliding_count": f"{_SLIDE} select cast(0 as bigint) as w, tseq as s, event_type, count(value) as n, {_SUM} as total from e group by tseq, event_type",
    "win_sliding_time": f"""with recursive s as (select *, epoch_us(ts) as us, row_number() over (order by ts, event_id) as seq from events),
tr as (select min(us) as last_us, cast(null as bigint) as seq from s union all
       select n.us, n.seq from tr, lateral (select us, seq from s where s.us >= tr.last_us + 7200000000 and (tr.seq is null or s.seq > tr.seq) order by seq limit 1) n)
select cast(0 as bigint) as w, tr.seq as s, event_type, count(value) as n, {_SUM} as total from tr join s on s.seq <= tr.seq and s.us >= tr.last_us - 3600000000 group by tr.seq, event_type""",
    "win_sliding_cumulative": f"""{_SLIDE}, p as (select tseq, event_type, count(value) as c, sum(cast(value as decimal(18, 2))) as v, min(value) as m from e group by tseq, event_type)
select cast(0 as bigint) as w, tseq as s, event_type, cast(sum(c) over g as bigint) as n, cast(sum(v) over g as double) / cast(sum(c) over g as double) as mean, min(m) over g as least
from p window g as (partition by event_type order by tseq rows between unbounded preceding and current row)""",
    "ss_join_tumbling_eq": _tumbling_join_sql("="),
    "ss_join_tumbling_ne": _tumbling_join_sql("<>"),
    "ss_join_sliding_eq": _sliding_join_sql("l.event_id, r.event_id as right_event_id", "="),
    "ss_join_sliding_ne": _sliding_join_sql("l.event_id, r.event_id as right_event_id", "<>"),
    "ss_join_collision": _sliding_join_sql(
        ", ".join(f"{_TS.format(side, side, side) if c == 'ts' else f'{side}.{c}'} as {prefix}{c}" for side, prefix in (("l", ""), ("r", "right_")) for c in STREAM), "="
    ),
    "st_join_eq": "select event_id, user_id, c_name, c_acctbal from events join customer on user_id = c_custkey",
    "st_join_ne": "select event_id, r_name from events join region on user_id <> r_regionkey",
    "st_join_collision": "select event_id, user_id, c_custkey as table_user_id, c_name from events join customer on user_id = c_custkey",
    "join_then_filter": "select event_id, c_mktsegment, c_acctbal from events join customer on user_id = c_custkey where c_acctbal > 1000",
    "join_then_agg": f"select event_type, count(event_id) as n, {_MEAN} as mean from events join customer on user_id = c_custkey where c_acctbal > 0 group by event_type",
    "agg_null_key": _simple("nullif(event_type, 'click') as event_type, count(value) as n, min(value) as least", "group by 1"),
    "ss_self_join": """select l.event_id, r.event_id as right_event_id from events l join events r on l.user_id = r.user_id
and r.ts between l.ts - interval 1 hour and l.ts + interval 1 hour where l.event_type = 'click' and r.event_type = 'click'""",
    "own_operator": "select event_id, user_id, event_type, value from (select * from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1) where value > 20",
    "live_filter_sink": _simple("event_id, value", "where value > 50"),
    "live_tumbling": f"{_B.format(size=3600000000, where='')} select event_type, {_AGGS} from b where w < (select max(w) from b) group by w, event_type",
    "live_early_fire": f"""{_B.format(size=3600000000, where='')}, k as (select *, row_number() over (partition by w order by seq) as nth from b),
e as (select k.w, {_FULL} as s, event_type, value from k where w < (select max(w) from k)
      union all select t.w, t.seq, k.event_type, k.value from k join k t on t.w = k.w and t.nth % 5 = 0 and k.seq <= t.seq)
select event_type, count(value) as n, {_SUM} as total from e group by w, s, event_type""",
    "live_sliding_join": _sliding_join_sql("l.event_id, r.event_id as right_event_id", "="),
    "table_create_insert": "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation union all select 100, 'ATLANTIS', null",
    "table_update": "select n_nationkey::bigint as n_nationkey, case when n_regionkey = 2 then 'SOMEWHERE' else n_name end as n_name, n_regionkey::bigint as n_regionkey from nation",
    "table_delete": "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation where n_regionkey <> 3",
    "table_add_column": "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey, cast(null as varchar) as note from nation union all select 101, null, null, 'new'",
    "table_select_limit": "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation order by n_nationkey limit 5",
    "table_schema": "select * from (values ('n_nationkey', 'INT'), ('n_name', 'STRING'), ('n_regionkey', 'INT')) t(name, type)",
    "table_list": "select * from (values ('a_region'), ('nation')) t(name)",
    "table_raw_sql": "select * from (values ('s1', 4.0::double, 2::bigint), ('s2', 4.0::double, 3::bigint)) t(sensor, total, latest)",
    "infer_output_schema": "select * from (values ('user_id', 'INT'), ('c_name', 'STRING'), ('COUNT(event_id)', 'INT'), ('MAX(event_type)', 'FLOAT')) t(name, type)",
}


def _draw_sql(seed: int) -> str:
    return f"(('0x' || substr(md5('{100 + seed}-' || n::varchar), 1, 8))::bigint::double / 4294967296.0)"


def _one_of_sql(seed: int, values) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[floor({_draw_sql(seed)} * {len(values)})::int + 1]"


def _ranged_sql(column: str, ranges: dict, seed: int) -> str:
    return "case " + "".join(f"when {column} = '{k}' then floor(({_draw_sql(seed)} * {high - low} + {low}) * 100) / 100 " for k, (low, high) in ranges.items()) + "end"


def _whole_sql(seed: int, low: int, high: int) -> str:
    return f"(floor({_draw_sql(seed)} * {high - low + 1})::bigint + {low})"


def _stamp_sql(every: int) -> str:
    return f"strftime(timestamp '2024-01-01' + to_seconds(n // {every}), '%Y-%m-%dT%H:%M:%S.%f') as timestamp"


_NUMBERS, _G = "(select range as n from range(1000))", generators
ORACLES |= {
    "gen_pollution": f"""select timestamp, sensor_id, pollutant, {_ranged_sql('pollutant', _G.POLLUTANTS, 3)} as value
from (select *, {_stamp_sql(1)}, {_one_of_sql(1, _G.SENSORS)} as sensor_id, {_one_of_sql(2, _G.POLLUTANTS)} as pollutant from {_NUMBERS})""",
    "gen_weather": f"select {_stamp_sql(1)}, {_one_of_sql(1, _G.SENSORS)} as sensor_id, floor(({_draw_sql(2)} * 70 + 20) * 100) / 100 as humidity, {_one_of_sql(3, _G.ZONES)} as zone from {_NUMBERS}",
    "gen_vehicle": f"""select timestamp, 'VH-' || {_whole_sql(1, 1000, 9999)}::varchar as vehicle_id, junction_id, {_ranged_sql('junction_id', _G.SPEEDS, 3)} as speed,
{_one_of_sql(4, _G.VEHICLES)} as vehicle_type, {_whole_sql(5, 1, 4)} as lane from (select *, {_stamp_sql(1)}, {_one_of_sql(2, _G.SPEEDS)} as junction_id from {_NUMBERS})""",
    "gen_signal": f"""select timestamp, junction_id, signal_phase, (case {' '.join(f"when signal_phase = '{k}' then {v}" for k, v in _G.PHASES.items())} end)::bigint as phase_duration,
floor({_draw_sql(2)} * 5)::bigint + case when {_draw_sql(1)} < (case {' '.join(f"when junction_id = '{k}' then {a / (a + b)}::double" for k, (a, b) in _G.CONGESTION.items())} end) then 1 else 6 end as congestion_level
from (select *, {_stamp_sql(5)}, 'J' || (n % 5 + 1)::varchar as junction_id, (['GREEN', 'YELLOW', 'RED'])[(n // 5) % 3 + 1] as signal_phase from {_NUMBERS})""",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["win_tumbling_cumulative"](spark, sf_dir)
