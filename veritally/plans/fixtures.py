"""Event streams derived from the driver's tables, in Spark, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import stable_fraction
from ..operators.order import numbered
from ..operators.quality import running_accuracy

TASKS = ("click", "error", "purchase", "signup", "view")
PEERS = 6


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    task = F.array_position(F.array(*[F.lit(t) for t in TASKS]), F.col("event_type")) - 1
    # an event becomes several answers, whose texts are read and graded in the tasks of its range
    out = numbered(raw, ["ts", "event_id"], bucket_rows=50_000)
    return out.select(F.col("event_id").alias("id"), "seq", F.col("event_type").alias("task"), (F.col("user_id") % 8).alias("source"), task.cast("long").alias("t"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).withColumn("peer", F.explode(F.array(*[F.lit(p).cast("long") for p in range(PEERS)])))
    rate = (3 + (F.col("peer") + F.col("t")) % 6).cast("double") / F.lit(10.0)
    return out.withColumn("correct", (stable_fraction("lab", F.col("peer"), F.col("id")) < rate).cast("int"))


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the running accuracy of their peer as estimate `prob`."""
    return running_accuracy(answers(spark, sf_dir), ["peer"], "prob")


def own(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = (4 + F.col("t") % 4).cast("double") / F.lit(10.0)
    return events(spark, sf_dir).withColumn("own_correct", (stable_fraction("lab", 6, F.col("id")) < rate).cast("int"))


def misleading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with what a misleading answer of the peer would be: usable or not, forced, wrong."""
    out = answers(spark, sf_dir)
    return out.withColumns({"usable": stable_fraction("acc", F.col("peer"), F.col("id")) < 0.85, "forced": stable_fraction("for", F.col("peer"), F.col("id")) < 0.1, "misleading_correct": F.lit(0)})


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's trust (best estimate), own estimate, and whether reading the sources or answering alone is right."""
    best = estimates(spark, sf_dir).groupBy("id", "seq", "task").agg(F.max("prob").alias("trust"))
    alone = running_accuracy(own(spark, sf_dir).withColumn("k", F.lit(0)), ["k"], "own_prob", label="own_correct").select("id", "own_prob", "own_correct")
    read_right = (stable_fraction("pm", F.col("id")) < F.lit(0.2) + F.lit(0.6) * F.col("trust")).cast("int")
    return best.join(alone, "id").withColumn("read_correct", read_right).withColumnRenamed("own_correct", "alone_correct")


# ---------------------------------------------------------------- the same as SQL


def u(text: str) -> str:
    return f"(CAST(CAST('0x' || substr(sha256({text}), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0)"


EV = """ev AS (SELECT event_id AS id, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, event_type AS task, user_id % 8 AS source,
  CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS BIGINT) AS t FROM events)"""
AN = f"""{EV}, an AS (SELECT id, seq, task, source, t, peer, CAST({u("'lab|' || peer || '|' || id")} < CAST(3 + (peer + t) % 6 AS DOUBLE) / 10 AS INTEGER) AS correct
  FROM ev, (SELECT unnest(range(0, 6)) AS peer))"""
PR = f"""{AN}, pr AS (SELECT *, floor(CAST(coalesce(sum(correct) OVER w, 0) + 1 AS DOUBLE) / CAST(count(*) OVER w + 2 AS DOUBLE) * 1e4 + 0.5e0) / 1e4 AS prob
  FROM an WINDOW w AS (PARTITION BY peer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
OWN = f"""ow AS (SELECT *, CAST({u("'lab|6|' || id")} < CAST(4 + t % 4 AS DOUBLE) / 10 AS INTEGER) AS own_correct FROM ev),
op AS (SELECT *, floor(CAST(coalesce(sum(own_correct) OVER w, 0) + 1 AS DOUBLE) / CAST(count(*) OVER w + 2 AS DOUBLE) * 1e4 + 0.5e0) / 1e4 AS own_prob
  FROM ow WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
MI = f"""{AN}, mi AS (SELECT *, {u("'acc|' || peer || '|' || id")} < 0.85e0 AS usable, {u("'for|' || peer || '|' || id")} < 0.1e0 AS forced, 0 AS misleading_correct FROM an)"""
BR = f"""{PR}, {OWN}, br AS (SELECT b.id, b.seq, b.task, trust, own_prob, CAST({u("'pm|' || b.id")} < 0.2e0 + 0.6e0 * trust AS INTEGER) AS read_correct, own_correct AS alone_correct
  FROM (SELECT id, seq, task, max(prob) AS trust FROM pr GROUP BY ALL) b JOIN op ON op.id = b.id)"""
