"""Every registered query of the engine against its SQL, and what a plan must look like."""

import duckdb
import pytest

import __spark_entry__
from streamloom import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


def _plain(value):
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    want = [tuple(map(_plain, r)) for r in con.sql(f"select {cols} from ({catalog.ORACLES[name]})").fetchall()]
    got = [tuple(map(_plain, r)) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    plain = _plan(catalog.QUERIES["filter_gt"](spark, sf_dir))
    assert "Exchange" not in plain and "PushedFilters: [IsNotNull(value), GreaterThan(value,50.0)]" in plain and "props" not in plain
    joined = _plan(catalog.QUERIES["st_join_eq"](spark, sf_dir))
    assert "BroadcastHashJoin" in joined and "SortMergeJoin" not in joined
    for name in ("ss_join_tumbling_ne", "ss_join_sliding_ne", "ss_join_sliding_eq", "win_sliding_count"):
        assert "CartesianProduct" not in _plan(catalog.QUERIES[name](spark, sf_dir))
