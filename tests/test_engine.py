"""Deployments fed event by event, with the event sequences that the documented and the coded semantics agree or differ on."""

import pytest

from streamloom.operators.custom import deduplicated
from streamloom.plans.deployment import Continuous, Deployment, DeploymentError
from streamloom.plans.query import QueryError
from streamloom.sources.tables import ReferenceTables
from streamloom.streaming.engine import Engine, Registry

POLLUTION = {"sensor_id": "STRING", "value": "FLOAT", "pollutant": "STRING"}
WEATHER = {"sensor_id": "STRING", "value": "FLOAT", "humidity": "FLOAT"}


class Clock:
    now = 0.0

    def __call__(self):
        return 1_000_000 + self.now


def document(*queries, size=10, velocity=("count", 1), kind=None, **more):
    streams = {"pollution": POLLUTION, "weather": WEATHER, "noise": {"dummy": "INT"}}
    doc = {
        "schema_name": "test", "window_size": size, "window_unit": "seconds", "velocity": {"type": velocity[0], "value": velocity[1]},
        "input_streams": [{"name": n, "topic": n, "schema": c} for n, c in streams.items()],
        "output_streams": [{"name": "out", "topic": "out", "schema": {"x": "STRING"}}],
        "continuous_queries": [{"name": f"q{k}", "input_stream": "pollution", "output_stream": "out", "query": q} for k, q in enumerate(queries)],
    }
    return doc | ({"window_type": kind} if kind else {}) | more


def fed(spark, doc, events, tables=None):
    clock = Clock()
    engine = Engine(spark, Deployment.from_document(doc), tables, clock)
    for at, stream, event in events:
        clock.now = at
        engine.process_event(stream, event)
    return engine


def p(at, value, sensor="s1"):
    return at, "pollution", {"sensor_id": sensor, "value": float(value)}


COUNT = "SELECT COUNT(value), SUM(value) FROM pollution"
EARLY = {"agg_state": "window", "tumbling_velocity": True}


def given(*pairs):
    return [{"COUNT(value)": n, "SUM(value)": float(s)} for n, s in pairs]


@pytest.mark.parametrize(
    "size,velocity,events,early",
    [
        (40, ("count", 3), [p(0, 4), p(1, 6), p(2, 9), p(3, 1)], [(3, 19)]),
        (40, ("count", 1), [p(0, 4), p(7, 6)], [(1, 4), (2, 10)]),
        (40, ("count", 4), [p(k, k) for k in range(9)], [(4, 6), (8, 28)]),
        (40, ("time", 7), [p(0, 5), p(6.5, 3), p(7.25, 2), p(14, 1)], [(3, 10)]),
        (40, ("time", 3), [p(0, 5), p(2.9, 3), p(3, 2), p(6, 1)], [(3, 10), (4, 11)]),
    ],
)
def test_tumbling_velocity(spark, size, velocity, events, early):
    assert fed(spark, document(COUNT, size=size, velocity=velocity, **EARLY), events).drain()["q0"] == given(*early)
    assert fed(spark, document(COUNT, size=size, velocity=velocity), events).drain()["q0"] == []


def test_tumbling_rollover_and_cumulative_state(spark):
    events = [p(0, 1), p(0, 2), p(5.0, 4), p(11.0, 8)]
    assert fed(spark, document(COUNT, size=5, velocity=("count", 100), agg_state="window"), events).drain()["q0"] == given((2, 3), (1, 4))
    assert fed(spark, document(COUNT, size=5, velocity=("count", 100)), events).drain()["q0"] == given((2, 3), (3, 7))


def test_drain_gives_each_row_once(spark):
    clock = Clock()
    engine = Engine(spark, Deployment.from_document(document(COUNT, size=5)), None, clock)
    seen = []
    engine.on_result("q0", seen.append)
    for at, value in ((0, 1), (6, 2)):
        clock.now = at
        engine.process_event("pollution", {"value": float(value)})
    assert engine.drain()["q0"] == given((1, 1)) and engine.drain()["q0"] == []
    clock.now = 12
    engine.process_event("pollution", {"value": 4.0})
    assert engine.drain()["q0"] == given((2, 3)) and seen == given((1, 1), (2, 3))


def test_sliding_count_and_time(spark):
    events = [p(0, 1), p(4, 2), p(5, 4), p(9, 8), p(20, 16)]
    per = {"kind": "sliding", "size": 5, "agg_state": "window"}
    assert fed(spark, document(COUNT, velocity=("count", 2), **per), events).drain()["q0"] == given((2, 3), (3, 14))
    assert fed(spark, document(COUNT, velocity=("time", 5), **per), events).drain()["q0"] == given((3, 7), (1, 16))
    assert fed(spark, document(COUNT, velocity=("count", 2), kind="sliding", size=5), events).drain()["q0"] == given((2, 3), (5, 17))


def test_time_velocity_average(spark):
    doc = document("SELECT sensor_id, AVG(value) FROM pollution", size=60, velocity=("time", 5), **EARLY)
    assert fed(spark, doc, [p(0, 10), p(4, 20), p(5, 30)]).drain()["q0"] == [{"sensor_id": "s1", "AVG(value)": 20.0}]


JOIN = "SELECT sensor_id, value, humidity FROM pollution INNER JOIN weather ON sensor_id = sensor_id"


def w(at, humidity, sensor="s1", **more):
    return at, "weather", {"sensor_id": sensor, "humidity": float(humidity)} | more


@pytest.mark.parametrize("op,a,b,n", [("=", "a", "a", 1), ("=", "a", "b", 0), ("!=", "a", "b", 1), ("!=", "a", "a", 0)])
def test_join_operators(spark, op, a, b, n):
    query, events = JOIN.replace("ON sensor_id =", f"ON sensor_id {op}"), [p(0, 17.5, a), w(2, 33, b)]
    assert len(fed(spark, document(query, kind="sliding"), events).drain()["q0"]) == n
    assert fed(spark, document(query), events).drain()["q0"] == []
    assert len(fed(spark, document(query), [*events, p(12, 1, "z")]).drain()["q0"]) == n


def test_join_noise_collision_and_missing_keys(spark):
    events = [p(0, 1, "a"), p(0, 2, "b"), w(0, 9, "z"), w(0, 3, "a"), w(0, 4, "b"), (0, "weather", {"humidity": 1.0}), (0, "pollution", {"value": 1.0})]
    rows = fed(spark, document(JOIN, kind="sliding", size=20), events).drain()["q0"]
    assert sorted(r["sensor_id"] for r in rows) == ["a", "b"]
    rows = fed(spark, document(JOIN.replace("sensor_id, value, humidity", "*"), kind="sliding"), [p(0, 10, "k1"), w(0, 30, "k1", value=99.0)]).drain()["q0"]
    assert rows == [{"sensor_id": "k1", "value": 10.0, "right_sensor_id": "k1", "right_value": 99.0, "humidity": 30.0}]


@pytest.mark.parametrize("size", [3, 8])
def test_join_expiry(spark, size):
    for at, n in ((size + 0.25, 0), (size, 1), (size / 2, 1)):
        assert len(fed(spark, document(JOIN, kind="sliding", size=size), [p(0, 1), w(at, 1)]).drain()["q0"]) == n


def test_many_joined_events(spark):
    events = [e for k in range(90) for e in (p(k / 10, k, f"s{k % 3}"), w(k / 10, k, f"s{k % 3}"))]
    assert fed(spark, document(JOIN, kind="sliding", size=40), events).results("q0").count() == 3 * 30 * 30


def test_batches_give_what_one_gives(spark):
    """Events drained a few at a time: nothing is given twice or lost, and the driver holds only those that wait."""
    events = [e for k in range(12) for e in (p(k * 2, k, f"s{k % 2}"), w(k * 2 + 1, k, f"s{k % 2}"))]
    docs = [document(JOIN, size=6), document(JOIN, kind="sliding", size=5), document("SELECT sensor_id, COUNT(value), SUM(value) FROM pollution", size=6, velocity=("count", 2), **EARLY)]
    for doc in docs:
        whole = fed(spark, doc, events).drain()["q0"]
        clock, rows = Clock(), []
        engine = Engine(spark, Deployment.from_document(doc), None, clock)
        for k, (at, stream, event) in enumerate(events):
            clock.now = at
            engine.process_event(stream, event)
            if k % 7 == 6:
                rows += engine.drain()["q0"]
                assert not any(engine._events.values())
        rows += engine.drain()["q0"]
        assert sorted(map(str, rows)) == sorted(map(str, whole)) and rows


def test_routing(spark):
    doc = document(JOIN + " WHERE value > 50", "SELECT sensor_id, value FROM pollution WHERE value > 60", kind="sliding")
    engine = Engine(spark, Deployment.from_document(doc))
    assert engine.process_event("noise", {"dummy": 1}) == []
    for s, v, h in (("a", 12.0, 30.5), ("b", 64.0, 18.0), ("c", 55.0, 20.0)):
        assert engine.process_event("pollution", {"sensor_id": s, "value": v}) == ["q0", "q1"]
        assert engine.process_event("weather", {"sensor_id": s, "humidity": h}) == ["q0"]
    out = engine.drain()
    assert sorted(r["sensor_id"] for r in out["q0"]) == ["b", "c"] and out["q1"] == [{"sensor_id": "b", "value": 64.0}]
    with pytest.raises(ValueError):
        engine.process_event("unknown", {})


def test_table_join_sees_changes(spark, tmp_path):
    tables = ReferenceTables(spark, tmp_path)
    tables.create_table("sensors", [("sensor_id", "STRING"), ("name", "STRING")])
    doc = document("SELECT sensor_id, table_sensor_id, name FROM pollution INNER JOIN sensors ON sensor_id = sensor_id")
    engine = fed(spark, doc, [p(0, 1)], tables)
    assert engine.drain()["q0"] == []
    tables.insert_row("sensors", {"sensor_id": "s1", "name": "one"})
    assert engine.drain()["q0"] == []  # an event meets the table as it is when its micro-batch runs
    engine.process_event("pollution", {"sensor_id": "s1", "value": 2.0})
    assert engine.drain()["q0"] == [{"sensor_id": "s1", "table_sensor_id": "s1", "name": "one"}]


def test_join_then_aggregate(spark):
    doc = document("SELECT sensor_id, COUNT(humidity) FROM pollution INNER JOIN weather ON sensor_id = sensor_id WHERE value > 0", kind="sliding", size=10, velocity=("count", 2))
    rows = fed(spark, doc, [p(0, 1), w(1, 1), w(2, 1), w(3, 1), w(4, 1)]).drain()["q0"]
    assert [r["COUNT(humidity)"] for r in rows] == [2, 6]


def test_registry(spark):
    registry = Registry(spark)
    engine = registry.register(document(COUNT))
    assert registry.list() == ["test"] and registry.engine("test") is engine and registry.config("test")["window_type"] == "tumbling"
    with pytest.raises(ValueError):
        registry.register(document(COUNT))
    registry.process_event("test", "pollution", {"value": 1.0})
    assert registry.replace(document(COUNT)) is not engine
    registry.unregister("test")
    with pytest.raises(ValueError):
        registry.engine("test")


def test_from_says_what_is_read(spark):
    engine = fed(spark, document("SELECT humidity FROM weather WHERE humidity > 5"), [w(0, 4), w(1, 6)])  # declared with input stream pollution
    assert engine.process_event("pollution", {"value": 1.0}) == [] and engine.drain()["q0"] == [{"humidity": 6.0}]


def test_created_streams_and_tables(spark, tmp_path):
    tables = ReferenceTables(spark, tmp_path)
    engine = Engine(spark, Deployment.from_document(document(COUNT)), tables)
    assert engine.define('CREATE STREAM more (k STRING, n INT) WITH (topic = "t"); CREATE TABLE kinds (k STRING, label STRING)') == ["more", "kinds"]
    tables.insert_row("kinds", {"k": "x", "label": "ex"})
    engine.add_query(Continuous("named", "more", "out", "SELECT n, label FROM more INNER JOIN kinds ON k = k"))
    for n in (55.0, 7, 1.5):
        engine.process_event("more", {"k": "x", "n": n})
    assert engine.drain()["named"] == [{"n": 55, "label": "ex"}, {"n": 7, "label": "ex"}, {"label": "ex"}]
    with pytest.raises(QueryError):
        engine.define("SELECT a FROM s")


def test_own_operators(spark):
    engine = Engine(spark, Deployment.from_document(document("SELECT sensor_id, value FROM pollution")), None, Clock())
    engine.add_operator("pollution", deduplicated("sensor_id"))
    for s, v in (("a", 1.0), ("b", 2.0), ("a", 3.0), (None, 4.0), (None, 5.0)):
        engine.process_event("pollution", {"sensor_id": s, "value": v})
    assert sorted(r["value"] for r in engine.drain()["q0"]) == [1.0, 2.0, 4.0]


def test_table_joins_by_size(spark, monkeypatch):
    from streamloom.operators import joins

    events = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, k string")
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "k string, m int")
    for op in ("=", "!="):
        want = sorted(map(tuple, joins.table_join(events, table, "k", op, "k").collect()))
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 20)
        found = joins.table_join(events, table, "k", op, "k")
        assert sorted(map(tuple, found.collect())) == want and len(want) == (2 if op == "=" else 4)
        assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.undo()


def test_refused(spark):
    for bad in ("CREATE TABLE t (a INT)", "SELECT a FROM nowhere", "SELECT a FROM pollution INNER JOIN nowhere ON a = b"):
        with pytest.raises(QueryError):
            Engine(spark, Deployment.from_document(document(bad)))
    for change in ({"window_size": 0}, {"window_unit": "days"}, {"window_type": "session"}, {"velocity": {"type": "count", "value": 0}}, {"input_streams": []}, {"tumbling_velocity": True}):
        with pytest.raises(DeploymentError):
            Deployment.from_document(document(COUNT) | change)
