"""Votes over answers of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_key(key: Column, slot: Column) -> Column:
    """Equal answers share a key; answers that cannot be read (null or empty) are alone."""
    return F.when(key.isNull() | (key == ""), F.concat(F.lit("alone "), slot.cast("string"))).otherwise(F.concat(F.lit("key "), key))


def plurality(answers: DataFrame, event: str, group: str, label: str, carry: list[str] | None = None) -> DataFrame:
    """One row an event: expected correctness under uniform tie-breaking, the winning group's size, how many groups tie."""
    groups = answers.groupBy(event, *(carry or []), group).agg(F.count("*").cast("int").alias("_votes"), F.avg(F.col(label).cast("double")).alias("_share"))
    by_size = groups.groupBy(event, *(carry or []), "_votes").agg(F.avg("_share").alias("_correct"), F.count("*").cast("int").alias("_tied"))
    best = F.max_by(F.struct("_correct", "_votes", "_tied"), "_votes")
    out = by_size.groupBy(event, *(carry or [])).agg(best.alias("_b"))
    return out.select(event, *(carry or []), F.col("_b._correct").alias("correct"), F.col("_b._votes").alias("votes"), F.col("_b._tied").alias("tied"))


def vote_summary(votes: DataFrame, task: str = "task") -> DataFrame:
    out = votes.groupingSets([[], [task]], task)
    return out.agg(F.grouping(task).cast("int").alias("overall"), F.count("*").alias("events"), F.avg("correct").alias("expected_accuracy"), F.avg(F.when(F.col("tied") > 1, 1.0).otherwise(0.0)).alias("tie_share"))
