"""Every llm query with SQL against DuckDB on the smallest test tables, and the rest for rows and a stable schema."""

import glob
import os

import duckdb
import pytest

from shorespark.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.sql(SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert len(rel.columns) == len(cols)
    assert got == sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and all(not t.startswith(("array", "map", "struct")) for _, t in df.dtypes)
    df.write.format("noop").mode("overwrite").save()
