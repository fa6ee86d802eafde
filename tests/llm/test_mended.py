"""Columns that have the names of results, and rows that come very often."""

import random

import pytest
from pyspark.sql import functions as F

from veritally.llm import decontaminate, mixing, near_dedup, quality_rules, secret_scan, substring_dedup, toxicity

from .data import sentence

ITEM = "what is the seventh letter of the word that was written on the old door of the tower"


def documents(spark, n=40):
    rng = random.Random(8)
    texts = [sentence(rng, 30) + (f" {ITEM} " if k % 10 == 3 else " password = hunter22x ") + sentence(rng, 20) + "\na line of the host that is on all pages\n" for k in range(n)]
    return spark.createDataFrame([(k, t, "de" if k % 2 else "en", "s", k % 2) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, mark int")


def operators(spark, docs):
    """Each operator of documents, on what the caller gives."""
    labels = docs.select("doc_id", F.col("mark").alias("toxic"), F.col("mark").alias("quality"))
    benchmark = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    return {
        "substring": lambda d: substring_dedup.substring_dedup(d),
        "toxicity": lambda d: toxicity.score_documents(d, toxicity.fit(docs, labels)),
        "secrets": lambda d: secret_scan.scan(d),
        "leaks": lambda d: decontaminate.with_leaks(d, benchmark),
        "rules": lambda d: quality_rules.quality_rules(d, max_documents=20),
        "near": lambda d: near_dedup.classes(d),
        "deduplicated": lambda d: near_dedup.deduplicated(d),
        "mixing": lambda d: mixing.mix_sources(d),
    }


@pytest.mark.parametrize("name", ["substring", "secrets", "leaks", "rules", "near", "deduplicated", "mixing", "toxicity"])
def test_a_callers_column_with_the_name_of_a_result_changes_nothing(spark, name):
    docs = documents(spark)
    run = operators(spark, docs)[name]
    plain = run(docs)
    added = [c for c in plain.columns if c not in docs.columns]
    clashing = docs.withColumns({c: F.lit("theirs") for c in added if not c.startswith("_")} | {"leaks": F.lit("theirs")})
    got = run(clashing)
    names = [c for c in plain.columns if not c.startswith("_")]
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert key(got.select(*names).collect()) == key(plain.select(*names).collect())
    for c in names:
        assert [x for x in got.columns].count(c) == 1


def test_an_array_column_of_the_shape_of_leaks_is_not_taken_for_leaks(spark):
    docs = documents(spark)
    shaped = docs.withColumn("leaks", F.array(F.struct(*[F.lit(k).cast("long").alias(n) for k, n in enumerate(("item_id", "distance", "start", "end"))])))
    got = {r.doc_id: r.leaks for r in decontaminate.with_leaks(shaped, spark.createDataFrame([(7, ITEM)], "item_id long, text string")).collect()}
    assert all(([x.item_id for x in v] == [7]) == (k % 10 == 3) and len(v) <= 1 for k, v in got.items())


def test_near_copies_with_very_many_rows_of_a_text(spark, monkeypatch):
    """Two near texts, 50,000 rows each with a null key and 1,000 with one key."""
    rng = random.Random(9)
    base = sentence(rng, 60)
    near = base.rsplit(" ", 2)[0] + " x y"
    sizes = []
    verified = near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, sets, least: (sizes.append((sets.count(), pairs.count())), verified(pairs, sets, least))[1])
    rows = spark.range(102_000).select(F.when(F.col("id") >= 2000, F.lit(None)).otherwise(F.col("id") % 2).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, base).otherwise(near).alias("text"))
    got = near_dedup.classes(rows).groupBy("class_id", "_chosen").count().collect()
    assert {(r.class_id, r["count"]) for r in got} == {(0, 51_000)} and sizes[0] == (2, 1)


def test_copies_of_a_document_count_each(spark):
    """A line of 30 copies and one other document of a host is on 31 documents."""
    rng = random.Random(10)
    line, copy = "the same line at the end of each page", sentence(rng, 40)
    texts = [(k, f"{copy}\n{line}", "h") for k in range(30)] + [(30, f"{sentence(rng, 40)}\n{line}", "h"), (31, f"{sentence(rng, 40)}\n{line}", "other")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df, max_documents=30).collect()}
    assert got[30].kept and got[30].n_removed_words == 9 and line not in got[30].text and got[31].n_removed_words == 0
    assert [got[k].kept for k in range(30)] == [True] * 30 and got[0].text == copy and got[0].n_removed_words == 9
    fewer = {r.doc_id: r for r in quality_rules.quality_rules(df, max_documents=29).collect()}
    assert not any(fewer[k].kept for k in range(30)) and fewer[30].kept and fewer[30].n_removed_words == 9
    assert all(r.n_removed_words == 0 for r in quality_rules.quality_rules(df, max_documents=31).collect())
