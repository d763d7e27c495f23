import pytest
from pyspark.sql import functions as F

from streamloom.plans.deployment import Stream
from streamloom.sources import generators, kafka
from streamloom.sources.tables import ReferenceTables, SessionTables, TableError


def test_reference_tables(spark, tmp_path):
    t = ReferenceTables(spark, tmp_path)
    t.create_table("sensors", [("id", "INT"), ("name", "TEXT"), ("on", "BOOLEAN")])
    t.create_table("sensors", [("other", "INT")])
    t.insert_row("sensors", {"id": 1, "name": "one", "on": True})
    t.insert_rows("sensors", [{"id": 2}, {"id": 3, "name": "three"}])
    assert t.table_schema("sensors") == [("id", "INT"), ("name", "TEXT"), ("on", "BOOLEAN")] and t.list_tables() == ["sensors"]
    assert t.update_rows("sensors", {"name": "x"}, {"id": 2}) == 1 and t.update_rows("sensors", {"name": "y"}, {"name": None}) == 0
    t.add_column("sensors", "zone", "STRING")
    t.insert_row("sensors", {"id": 4, "zone": "north"})
    rows = {r["id"]: r for r in t.select_rows("sensors")}
    assert rows[2] == {"id": 2, "name": "x", "on": None, "zone": None} and rows[4]["zone"] == "north"
    assert t.delete_rows("sensors", {"name": "x", "id": 2}) == 1 and t.frame("sensors").count() == 3
    assert len(t.select_rows("sensors", 2)) == 2 and t.declared_schema("sensors")["name"] == "STRING"
    for bad in (
        lambda: t.create_table("a b", [("x", "INT")]), lambda: t.create_table("a", []), lambda: t.insert_row("sensors", {}), lambda: t.insert_row("sensors", {"nope": 1}),
        lambda: t.update_rows("sensors", {}, {"id": 1}), lambda: t.delete_rows("sensors", {}), lambda: t.frame("none"), lambda: t.add_column("sensors", "id", "INT"),
    ):
        with pytest.raises(TableError):
            bad()


def test_session_tables(spark):
    t = SessionTables(spark)
    t.create_table("r", {"a": "INT", "b": "STRING"})
    t.insert("r", {"a": 1, "b": "x"})
    t.insert_batch("r", [{"a": 2}, {"a": 3, "b": "left out: the first row has no b"}])
    assert t.query("SELECT a, b FROM r ORDER BY a").toPandas().values.tolist() == [[1, "x"], [2, None], [3, None]]
    t.close()


def test_generators(spark):
    for kind in generators.KINDS:
        df = generators.generated(spark, kind, 50, 7)
        assert df.count() == 50 and "timestamp" in df.columns and generators.live(spark, kind).isStreaming
    lasts = {r.signal_phase: r.phase_duration for r in generators.generated(spark, "signal", 60).collect()}
    assert lasts == generators.PHASES
    wrong = generators.generated(spark, "pollution", 500, 3).filter((F.col("pollutant") == "CO2") != (F.col("value") >= 300))
    assert wrong.count() == 0


def test_messages(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "no"}',), ("not json",)], "value string")
    found = kafka.parsed(df, Stream("s", "t", {"a": "INT", "b": "STRING"}))
    assert [tuple(r) for r in found.collect()] == [(1, "x"), (None, None), (None, None)]
    assert [r.value for r in kafka.as_messages(found.limit(1)).collect()] == ['{"a":1,"b":"x"}'] and kafka.as_messages(found).collect()[1].value == "{}"
