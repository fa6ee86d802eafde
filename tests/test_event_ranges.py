"""Event queries where the stream is numbered in several ranges, against their SQL in DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from veritally.operators.order import numbered
from veritally.plans import fixtures

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture
def ranges(monkeypatch):
    """Ranges of 90 events, as large tables have them of many."""
    monkeypatch.setattr(fixtures, "numbered", lambda df, order, *_, **__: numbered(df, order, bucket_rows=90))


@pytest.mark.parametrize("name", ["favourite_on_mixed", "feature_join", "feature_scan", "feature_subset"])
def test_query_in_ranges_equals_sql(spark, ranges, name):
    c = pytest.importorskip("duckdb").connect()
    for f in ("events", "embeddings"):
        c.sql(f"CREATE VIEW {f} AS SELECT * FROM '{FOLDER}/{f}.parquet'")
    result = c.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, FOLDER).select(*result.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, result.fetchall()))
