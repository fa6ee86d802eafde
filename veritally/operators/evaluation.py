"""Evaluations of graded rows: summaries, curves, controls, tilt and leave-one-out evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import logit, tilt
from .order import edges

PREFIXES = (250, 500, 1000, 2000, 4000, 8000, 16000)


def summarise(rows: DataFrame, task: str = "task") -> DataFrame:
    """By task and over all (task null): accuracy of `correct`, oracle of any peer, strict majority of `rights` out of `n`."""
    oracle = F.when(F.col("rights") > 0, 1).otherwise(0)
    majority = F.when(F.col("rights") * 2 > F.col("n"), 1).otherwise(0)
    sums = [F.count("*").alias("events"), F.sum(F.col("correct").cast("long")).alias("rights_total"), F.sum(oracle.cast("long")).alias("oracle_total"), F.sum(majority.cast("long")).alias("majority_total")]
    out = rows.groupingSets([[], [task]], task).agg(F.grouping(task).cast("int").alias("overall"), *sums)
    for name in ("rights", "oracle", "majority"):
        out = out.withColumn(f"{name}_share", F.col(f"{name}_total").cast("double") / F.greatest(F.lit(1), F.col("events")).cast("double"))
    return out.drop("rights_total", "oracle_total", "majority_total")


def curve(rows: DataFrame, n: int, windows: int, pos: str = "seq", hit: str = "correct") -> DataFrame:
    """(part, events, rights): `window k` of equal counts, both halves, and prefixes that fit."""
    cuts = edges(n, windows, "floor")
    spans = [(f"window {k}", a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    spans += [("first half", 0, n // 2), ("second half", n // 2, n)] + [(f"first {k}", 0, k) for k in PREFIXES if k <= n]
    inside = lambda a, b: (F.col(pos) >= a) & (F.col(pos) < b)
    one = rows.agg(*[x for k, (_, a, b) in enumerate(spans) for x in (F.sum(F.when(inside(a, b), 1).otherwise(0)).cast("long").alias(f"n{k}"), F.sum(F.when(inside(a, b), F.col(hit)).otherwise(0)).cast("long").alias(f"r{k}"))])
    parts = F.array(*[F.struct(F.lit(name).alias("part"), F.col(f"n{k}").alias("events"), F.col(f"r{k}").alias("rights")) for k, (name, _, _) in enumerate(spans)])
    return one.select(F.explode(parts).alias("x")).select("x.*")


def swapped(answers: DataFrame, event: str, slot: str, score: str, name: str = "swapped") -> DataFrame:
    """Give the slot of ascending rank i the score of rank n - 1 - i (ranks are stable in slot order)."""
    per_event = Window.partitionBy(event)
    rank = F.row_number().over(per_event.orderBy(score, slot))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(score).alias("s"), F.col(slot).alias("k"))).over(per_event))
    return answers.withColumn("_rank", rank).withColumn("_all", ordered).withColumn(name, F.get("_all", F.size("_all") - F.col("_rank"))["s"]).drop("_rank", "_all")


def tilted(answers: DataFrame, event: str, score: str, gamma: float, form: str = "logratio", name: str = "tilt") -> DataFrame:
    per_event = Window.partitionBy(event)
    return answers.withColumn(name, tilt(F.col(score), F.max(score).over(per_event), F.min(score).over(per_event), gamma, form))


def leave_one_out(answers: DataFrame, event: str, score: str, count: str, scale: float = 100.0) -> DataFrame:
    """Add own_logit, support (a saturating count, 1 at most), others_max and others_mean (0 for a lone answer)."""
    per_event = Window.partitionBy(event)
    out = answers.withColumn("own_logit", logit(F.col(score)))
    values = F.array_sort(F.collect_list("own_logit").over(per_event))
    out = out.withColumn("_v", values).withColumn("_n", F.size("_v")).withColumn("_top", F.get("_v", F.col("_n") - 1))
    alone = F.col("_n") == 1
    out = out.withColumn("others_max", F.when(alone, 0.0).when(F.col("own_logit") < F.col("_top"), F.col("_top")).otherwise(F.get("_v", F.col("_n") - 2)))
    total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("others_mean", F.when(alone, 0.0).otherwise((total - F.col("own_logit")) / (F.col("_n") - 1).cast("double")))
    support = F.least(F.lit(1.0), F.log1p(F.greatest(F.col(count).cast("double"), F.lit(0.0))) / F.log1p(F.lit(scale)))
    return out.withColumn("support", support).drop("_v", "_n", "_top")
