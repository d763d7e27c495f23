import json

import pytest

from streamloom.functions.types import infer_output_schema
from streamloom.plans.deployment import Deployment, DeploymentError, Windowing
from streamloom.plans.query import Condition, Create, Item, Join, QueryError, Select, parse, parse_all
from streamloom.sources import kafka


@pytest.mark.parametrize(
    "text,plan",
    [
        ("SELECT a FROM s", Select((Item("a"),), "s")),
        ("SELECT * FROM s;", Select((), "s", True)),
        ("SELECT a, COUNT(b) FROM s GROUP BY a, c", Select((Item("a"), Item("b", "COUNT")), "s", group_by=("a", "c"))),
        ("SELECT a FROM s WHERE v >= -2.5", Select((Item("a"),), "s", where=Condition("v", ">=", -2.5))),
        ('SELECT a FROM s WHERE v = "x y"', Select((Item("a"),), "s", where=Condition("v", "=", "x y"))),
        ("SELECT a FROM s WHERE v != 3", Select((Item("a"),), "s", where=Condition("v", "!=", 3))),
        ("SELECT a FROM s INNER JOIN t ON k != m WHERE v < 1 GROUP BY a", Select((Item("a"),), "s", False, Join("t", "k", "!=", "m"), Condition("v", "<", 1), ("a",))),
        ('CREATE STREAM s (a INT, b FLOAT) WITH (topic = "t", x = "y")', Create("STREAM", "s", (("a", "INT"), ("b", "FLOAT")), {"topic": "t", "x": "y"})),
        ("CREATE TABLE t (a STRING, b BOOLEAN, c TIMESTAMP)", Create("TABLE", "t", (("a", "STRING"), ("b", "BOOLEAN"), ("c", "TIMESTAMP")))),
    ],
)
def test_parse(text, plan):
    assert parse(text) == plan


@pytest.mark.parametrize(
    "text",
    ["", "SELECT FROM s", "select a from s", "SELECT a FROM s WHERE a > b", "SELECT a FROM s WHERE a > 1 AND b < 2", "SELECT a FROM s LEFT JOIN t ON a = b", "SELECT a AS b FROM s",
     "SELECT COUNT(*) FROM s", "SELECT a FROM s ORDER BY a", "SELECT a FROM s LIMIT 1", "SELECT a FROM s WHERE a = 'x'", "SELECT a + b FROM s", "SELECT a FROM s INNER JOIN t ON a < b"],
)
def test_rejected(text):
    with pytest.raises(QueryError):
        parse(text)


def test_statements():
    assert len(parse_all("SELECT a FROM s SELECT b FROM t")) == 2 and len(parse_all("SELECT a FROM s; SELECT b FROM t;")) == 2
    assert parse("SELECT a, b, COUNT(x) FROM s").keys == ("a", "b")
    assert parse("SELECT a, b, COUNT(x) FROM s GROUP BY a").keys == ("a",)


def test_inferred_schema():
    orders, parts = {"order_id": "INT", "part": "STRING", "price": "FLOAT"}, {"part": "STRING", "stock": "INT", "price": "FLOAT"}
    plan = parse("SELECT order_id, right_price, stock, unheard_of FROM orders INNER JOIN parts ON part = part")
    assert infer_output_schema(plan, orders, parts) == {"order_id": "INT", "right_price": "FLOAT", "stock": "INT", "unheard_of": "STRING"}
    plan = parse("SELECT part, table_price, MAX(price), COUNT(order_id) FROM orders INNER JOIN parts ON part = part")
    assert infer_output_schema(plan, orders, parts, "table_") == {"part": "STRING", "table_price": "FLOAT", "MAX(price)": "FLOAT", "COUNT(order_id)": "INT"}
    assert infer_output_schema(parse("SELECT * FROM orders"), orders) == orders


def test_deployment_files(tmp_path):
    doc = {
        "schema_name": "d", "window_size": 10, "window_unit": "minutes", "velocity": {"type": "time", "value": 10},
        "input_streams": [{"name": "s", "topic": "t", "schema": {"a": "INT"}}], "output_streams": [{"name": "o", "topic": "o", "schema": {"a": "INT"}}],
        "continuous_queries": [{"name": "q", "input_stream": "s", "output_stream": "o", "query": "SELECT a FROM s"}],
    }
    found = Deployment.from_document(doc)
    found.save(tmp_path / "x" / "d.json")
    assert Deployment.load(tmp_path / "x" / "d.json") == found and found.windowing.micros == 600_000_000
    assert Deployment.read_lines([*json.dumps(doc, indent=1).split("\n"), "END", "more"]) == found
    for change in (
        {"input_streams": doc["input_streams"] * 2}, {"input_streams": [{"name": "s", "topic": "t", "schema": {"a": "DECIMAL"}}]},
        {"continuous_queries": [doc["continuous_queries"][0] | {"output_stream": "none"}]}, {"continuous_queries": doc["continuous_queries"] * 2}, {"velocity": 3}, {"window_size": "10"},
    ):
        with pytest.raises(DeploymentError):
            Deployment.from_document(doc | change)
    for key in doc:
        with pytest.raises(DeploymentError):
            Deployment.from_document({k: v for k, v in doc.items() if k != key})
    assert Windowing("SLIDING", 5, "Weeks").micros == 5_000_000


def test_kafka_settings():
    s = kafka.default_settings()
    assert not s.is_persistent() and s.topic_config()["log.retention.ms"] == 1 and "ephemeral" in s.describe()
    assert s.producer_options()["kafka.acks"] == "all" and s.consumer_options()["startingOffsets"] == "latest"
    kafka.set_default_settings("broker:1")
    assert kafka.default_settings().consumer_options()["kafka.bootstrap.servers"] == "broker:1"
    kafka.set_default_settings()
