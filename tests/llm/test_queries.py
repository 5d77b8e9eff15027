"""The operator queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tarnspark.llm import registry
from tarnspark.sources.tables import NAMES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = registry.QUERIES[name](spark, SF), c.sql(registry.ORACLES[name])

    def rows(columns, rs):
        at = [list(columns).index(k) for k in sorted(columns)]
        return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in (r[i] for i in at)) for r in rs)

    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_labels_agree_with_the_classifier(spark):
    import __spark_entry__  # noqa: F401

    got = {r["doc_id"]: r["kept"] for r in registry.QUERIES["op10_weak_label_quality"](spark, SF).collect()}
    hand = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    assert sum(got[d] == bool(q) for d, q in hand) / len(hand) >= 0.97
    assert sum(got[d] for d, q in hand if q) / max(1, sum(q for _, q in hand)) >= 0.99
