"""The registered queries: against their SQL on the smallest tables, and what learned ones may and may not see."""

import binascii
import os

import pytest
from pyspark.sql import functions as F

from veritally.llm import language_id, quality_crf, queries, toxicity

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(repr([r[n] for n in names]) for r in df.collect())
    result = duck.sql(queries.ORACLE[name])
    assert sorted(result.columns) == names
    places = [result.columns.index(n) for n in names]
    assert got == sorted(repr([r[k] for k in places]) for r in result.fetchall())


LEARNED = {"op2_language_id": (4, 2), "op4_toxicity": (4, 2), "op9_quality_crf": (3, 1)}


@pytest.fixture(scope="module")
def scored(spark):
    return {name: queries.QUERIES[name](spark, FOLDER).collect() for name in LEARNED}


@pytest.mark.parametrize("name", sorted(LEARNED))
def test_held_out_rows_are_marked_and_scores_bounded(spark, scored, name):
    parts, held = LEARNED[name]
    rows = scored[name]
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % parts == held) and 0 <= r.score <= 1 for r in rows)
    if name != "op2_language_id":
        least = 0.3 if name == "op4_toxicity" else 0.5
        assert all(r.predicted == int(r.score >= least) for r in rows)


@pytest.mark.parametrize("name", sorted(LEARNED))
def test_held_out_labels_change_no_score(spark, tmp_path, scored, name):
    parts, held = LEARNED[name]
    held_out = F.crc32(F.col("doc_id").cast("string")) % parts == held
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    docs.withColumn("lang", F.when(held_out, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("elsewhere")).write.parquet(str(tmp_path / "documents.parquet"))
    for c in ("quality", "toxic"):
        labels = labels.withColumn(c, F.when(held_out, (1 - F.col(c)).cast("int")).otherwise(F.col(c)))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    again = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, scored[name]))


def test_held_out_language_and_labels_are_right(spark, scored):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang IS NOT NULL").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    right = [r.lang_pred == lang[r.doc_id] for r in scored["op2_language_id"] if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert sum(right) >= 0.95 * len(right)
    for name, label in (("op4_toxicity", "toxic"), ("op9_quality_crf", "quality")):
        right = [r.predicted == labels[r.doc_id][label] for r in scored[name] if r.held_out and r.doc_id in labels]
        assert sum(right) >= 0.85 * len(right)


def test_a_sample_does_not_depend_on_the_order_of_rows(spark):
    """Keys with several labels and texts."""
    data = [(k % 20, f"text {k}", "en" if k % 3 else "de") for k in range(60)]
    schema = "doc_id long, text string, lang string"
    got = []
    for rows in (data, data[::-1], data[30:] + data[:30]):
        got.append([x.tolist() for x in language_id.labelled_sample(spark.createDataFrame(rows, schema).repartition(3), None, "lang", 10, 4, 2)])
    assert got[0] == got[1] == got[2] and len(got[0][0]) == 10
    few = language_id.labelled_sample(spark.createDataFrame(data, schema), None, "lang", 10, 4, 2, most_bytes=20)
    assert 1 <= len(few[0]) <= 3 and set(few[0]) <= set(got[0][0])
    assert toxicity.SAMPLE_ROWS == 8000 and quality_crf.SAMPLE_ROWS == 4000
