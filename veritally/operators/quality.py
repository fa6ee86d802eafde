"""Quality of estimates against labels: accuracies, ranking, favourites, partition, along the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import places
from .prefix import earlier_sums


def running_accuracy(answers: DataFrame, keys: list[str], name: str, pos: str = "seq", label: str = "correct", digits: int = 4, block: int = 100_000) -> DataFrame:
    """(right + 1) / (seen + 2) over strictly earlier answers of the keys, to `digits` places."""
    out = earlier_sums(answers, keys, pos, {"_right": F.col(label).cast("long"), "_seen": F.lit(1).cast("long")}, block)
    value = (F.col("_right") + 1).cast("double") / (F.col("_seen") + 2).cast("double")
    return out.withColumn(name, places(value, digits)).drop("_right", "_seen")


def hindsight_accuracy(answers: DataFrame, keys: list[str], name: str, label: str = "correct") -> DataFrame:
    """The share of right answers of the keys over the whole stream."""
    share = answers.groupBy(*keys).agg((F.sum(label).cast("double") / F.greatest(F.lit(1), F.count("*")).cast("double")).alias(name))
    return answers.join(share, keys)


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None, name: str = "auc") -> DataFrame:
    """P(score of a right one > score of a wrong one), ties half; null if one kind is missing.

    Rows are combined by score before anything is ordered: with scores of a fixed number of places the window below sees
    at most that many rows a group.
    """
    by = by or []
    counts = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.sum(1 - F.col(label).cast("long")).alias("_n"))
    below = Window.partitionBy(*(by or [F.lit(0)])).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_less", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    won = F.sum(F.col("_p").cast("double") * (F.col("_less").cast("double") + F.col("_n").cast("double") / 2.0))
    return counts.groupBy(*by).agg(F.try_divide(won, F.sum("_p").cast("double") * F.sum("_n").cast("double")).alias(name))


def favourite(answers: DataFrame, event: str, slot: str, score: str, label: str, carry: list[str] | None = None) -> DataFrame:
    """One row an event: the first slot of the highest score and its label, with counts, spread and rights."""
    best = F.max_by(F.struct(slot, F.col(label).alias("label")), F.struct(score, (-F.col(slot)).alias("s")))
    cols = [best.alias("_best"), F.count("*").cast("int").alias("n"), F.sum(label).cast("int").alias("rights"), (F.max(score) - F.min(score)).alias("spread")]
    out = answers.groupBy(event, *(carry or [])).agg(*cols)
    return out.select(event, *(carry or []), F.col(f"_best.{slot}").alias("favourite"), F.col("_best.label").alias("favourite_right"), "n", "rights", "spread")


def mixed(favourites: DataFrame) -> DataFrame:
    """Events whose answers are not all right or all wrong."""
    return favourites.filter((F.col("rights") > 0) & (F.col("rights") < F.col("n")))


def partition_label(flat: float = 0.1) -> Column:
    majority = F.when(F.col("rights") * 2 > F.col("n"), 1).otherwise(0)
    return (
        F.when((F.col("rights") == 0) | (F.col("rights") == F.col("n")), "unanimous")
        .when(F.col("spread") <= flat, "split, flat")
        .when(F.col("favourite_right") == majority, "split, favourite with the majority")
        .otherwise("split, favourite against the majority")
    )


def peer_accuracy(answers: DataFrame, peer: str = "peer", task: str = "task", label: str = "correct") -> DataFrame:
    """Answers and rights by peer, and by peer and task (task is null for the former)."""
    both = answers.groupingSets([[peer], [peer, task]], peer, task)
    return both.agg(F.grouping(task).cast("int").alias("all_tasks"), F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("rights"))
