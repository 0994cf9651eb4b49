"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else str(x))
    return sorted(map(repr, df.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        assert rows(found) == rows(duck.execute(sql).df())
    else:
        assert len(found)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
