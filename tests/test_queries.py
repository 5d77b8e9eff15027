"""Every registered query that has an oracle, against DuckDB on the smallest tables, and the entry module's contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tarnspark import queries as Q
from tarnspark.sources.tables import NAMES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(columns, rows):
    at = [list(columns).index(c) for c in sorted(columns)]
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in (r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_against_duckdb(spark, duck, name):
    df, rel = Q.QUERIES[name](spark, SF), duck.sql(Q.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


@pytest.mark.parametrize("widgets,words", [(100_001, 9), (9, 2_001)])
def test_partial_names_of_many_rows_or_many_words(spark, tmp_path, widgets, words):
    """Over 100,000 rows answer, or over 2,000 words begin as the one asked for."""
    c = duckdb.connect()
    for t in ("customer", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    c.execute(f"CREATE TABLE part AS SELECT i AS p_partkey, CASE WHEN i < {words} THEN 'sma' || i || ' ring' WHEN i % 3 = 0 THEN 'old widget' ELSE 'red widget' END AS p_name FROM range({widgets + words}) r(i)")
    for t in ("customer", "nation", "part"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    df, rel = Q.QUERIES["e_partial_names"](spark, str(tmp_path)), c.sql(Q.ORACLES["e_partial_names"])
    rows = df.collect()
    assert {(r.asked, r.total) for r in rows} >= {("widget", widgets), ("sma rin", words)}
    assert rows_of(df.columns, rows) == rows_of(rel.columns, rel.fetchall())


def test_contract(spark):
    assert entry.entry(spark).count() >= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down_and_prune(spark):
    plan = Q.QUERIES["f3_scalar_sum"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "o_orderpriority" not in plan
    plan = Q.QUERIES["q01_top_orders"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    plan = Q.QUERIES["p_exists"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
