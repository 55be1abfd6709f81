"""The registered queries against their oracles on the smallest tables, if these are there."""

import glob
import os

import pytest

import __spark_entry__ as entry
from martlake.plans import registry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def rows(df):
    return sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n != "churn_scores"])
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
