"""Every query with SQL against DuckDB on the smallest tables, where they are there."""

import math
import os

import pytest

import __spark_entry__ as entry
from veritally.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    result = duck.sql(catalogue.ORACLE[name])
    places = [result.columns.index(n) for n in names]
    assert sorted(result.columns) == names
    assert got == sorted(repr([plain(r[k]) for k in places]) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
