"""Summaries of answer tables: graded answers, revised answers, misleading attempts, checks, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _share(c, name: str):
    return (F.lit(100.0) * F.sum(F.when(c, 1).otherwise(0)).cast("double") / F.greatest(F.lit(1), F.count("*")).cast("double")).alias(name)


def answer_summary(answers: DataFrame, source: str = "source") -> DataFrame:
    """Answers and percent right, by source and over all (source null)."""
    out = answers.groupingSets([[], [source]], source)
    return out.agg(F.grouping(source).cast("int").alias("overall"), F.count("*").alias("answers"), _share(F.col("correct") == 1, "accuracy"))


def turn_statistics(answers: DataFrame) -> DataFrame:
    """Of answers revised over turns: mean turns, visible checks passed at first and last, in percent."""
    passed = lambda at: F.coalesce(F.try_element_at("visible", F.lit(at))["passed"], F.lit(False))
    return answers.agg(F.count("*").alias("answers"), F.avg("turns").alias("mean_turns"), _share(passed(1), "passed_first"), _share(passed(-1), "passed_last"))


def rights_by_turns(answers: DataFrame) -> DataFrame:
    return answers.groupBy("turns").agg(F.count("*").alias("answers"), _share(F.col("correct") == 1, "accuracy"))


def acceptance_summary(attempts: DataFrame, task: str = "task") -> DataFrame:
    """Attempts, accepted, forced and soft ones, by task and over all (task null)."""
    n = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)
    out = attempts.groupingSets([[], [task]], task)
    return out.agg(F.grouping(task).cast("int").alias("overall"), F.count("*").alias("attempts"), n(F.col("accepted"), "accepted_attempts"), n(F.col("forced"), "forced_attempts"), n(F.size("soft") > 0, "soft_attempts"), _share(F.col("accepted"), "usable_share"))


def reason_histogram(attempts: DataFrame) -> DataFrame:
    return attempts.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("attempts"))


def rejection_share(verdicts: DataFrame, verdict: str = "verdict") -> DataFrame:
    return verdicts.agg(F.count("*").alias("reports"), _share(F.col(verdict) == "REJECT", "rejected"))


def length_statistics(prompts: DataFrame, text: str, pos: str, first: int | None = None) -> DataFrame:
    """Least, median and greatest length of the prompts, or of those at the places below `first`."""
    some = prompts if first is None else prompts.filter(F.col(pos) < first)
    n = F.length(text)
    return some.agg(F.min(n).alias("least"), F.floor(F.percentile(n, 0.5)).cast("long").alias("median"), F.max(n).alias("most"))


def feedback_shares(rows: DataFrame, ratio: str, correct: str = "correct", reads: str = "reads", alone: str = "alone_correct") -> DataFrame:
    """By feedback ratio: accuracy, share of events that were read, accuracy alone."""
    return rows.groupBy(ratio).agg(F.count("*").alias("events"), _share(F.col(correct) == 1, "accuracy"), _share(F.col(reads), "read_share"), _share(F.col(alone) == 1, "alone_accuracy"))


def regraded(generations: DataFrame, graded: DataFrame, event: str = "id", task: str = "task_type") -> DataFrame:
    """Verdicts graded anew (code keeps its own), with the old ones as `before`."""
    new = graded.select(event, F.col("correct").alias("_new"))
    out = generations.withColumnRenamed("correct", "before").join(new, event, "left")
    return out.withColumn("correct", F.when(F.col(task) == "code", F.col("before")).otherwise(F.coalesce("_new", "before"))).drop("_new")
