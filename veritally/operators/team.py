"""Multi-hop questions: one event a hop, with earlier answers filled in, and views of retrieved paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled_question
from .retrieval import bm25, top


def paragraphs(questions: DataFrame) -> DataFrame:
    """Distinct paragraphs with an id by content, and their text."""
    flat = questions.select(F.explode("paragraphs").alias("p")).select("p.title", "p.paragraph_text").distinct()
    return flat.select(F.xxhash64("title", "paragraph_text").alias("doc_id"), F.concat_ws(": ", "title", "paragraph_text").alias("text"))


def hops(questions: DataFrame) -> DataFrame:
    """One row a hop: id `<question>/h<k>`, the filled question, its answer, the supporting paragraph, the question's pool."""
    rows = questions.select("id", F.col("answer_aliases"), "paragraphs", F.size("question_decomposition").alias("sub_tasks"), F.posexplode("question_decomposition").alias("h", "step"))
    earlier = Window.partitionBy("id").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_golds", F.collect_list("step.answer").over(earlier))
    support = F.get("paragraphs", F.col("step.paragraph_support_idx"))
    return rows.select(
        F.concat_ws("/h", "id", (F.col("h") + 1).cast("string")).alias("id"),
        F.col("id").alias("question_id"),
        (F.col("h") + 1).alias("sub_task"),
        "sub_tasks",
        (F.col("h") + 1 == F.col("sub_tasks")).alias("last"),
        filled_question(F.col("step.question"), F.col("_golds")).alias("problem"),
        F.col("step.answer").alias("answer"),
        F.when(F.col("h") + 1 == F.col("sub_tasks"), F.coalesce("answer_aliases", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("answer_aliases"),
        F.when(F.col("step.paragraph_support_idx").isNotNull(), F.xxhash64(support["title"], support["paragraph_text"])).alias("support"),
        F.transform("paragraphs", lambda p: F.xxhash64(p["title"], p["paragraph_text"])).alias("pool"),
    )


def retrieved(events: DataFrame, docs: DataFrame, k: int, local: bool) -> DataFrame:
    """(id, doc_id, rank): the best k paragraphs of each hop, of its question's pool or of all."""
    scores = bm25(docs, events.select(F.col("id").alias("item_id"), F.col("problem").alias("text")))
    if local:
        pool = events.select(F.col("id").alias("item_id"), F.explode("pool").alias("doc_id")).distinct()
        scores = pool.join(scores, ["item_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return top(scores, "item_id", "doc_id", k).select(F.col("item_id").alias("id"), "doc_id", "rank")


def support_found(events: DataFrame, ranked: DataFrame) -> DataFrame:
    """Hops, and those whose supporting paragraph was retrieved."""
    hit = events.select("id", F.col("support").alias("doc_id")).join(ranked.select("id", "doc_id"), ["id", "doc_id"], "left_semi").count()
    return events.agg(F.count("*").alias("hops"), F.lit(hit).cast("long").alias("found"))
