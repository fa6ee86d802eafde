"""Arbitration between the own answer and the sources: a prefix regression with two parameters a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.maths import read_value, reads_when, switch_point
from .prefix import earlier_sums

_SUMS = ("s11", "s12", "s22", "q1", "q2")


def _terms(trust: str, own: str, label: str) -> dict:
    """The terms of the normal equations, exactly: trust and own have four places, so they are counted in ten-thousandths.

    u = (T, T - 1), z = label - (1 - T) own; P += u u', q += u z.
    """
    whole = lambda c: F.round(F.col(c) * 10000).cast("decimal(38,0)")
    one = F.lit(10000).cast("decimal(38,0)")
    t, k = whole(trust), whole(own)
    y = F.col(label).cast("decimal(38,0)")
    z = y * one * one - (one - t) * k
    return {"s11": (t * t).cast("decimal(38,0)"), "s12": (t * (t - one)).cast("decimal(38,0)"), "s22": ((t - one) * (t - one)).cast("decimal(38,0)"), "q1": (t * z).cast("decimal(38,0)"), "q2": ((t - one) * z).cast("decimal(38,0)")}


def _solve(df: DataFrame, prior: tuple[float, float], precision: float) -> DataFrame:
    d = {n: F.col(n).cast("double") / F.lit(1e8 if n[0] == "s" else 1e12) for n in _SUMS}
    a, b, c = d["s11"] + F.lit(precision), d["s12"], d["s22"] + F.lit(precision)
    x, y = d["q1"] + F.lit(precision * prior[0]), d["q2"] + F.lit(precision * prior[1])
    det = a * c - b * b
    return df.withColumn("rho", (x * c - b * y) / det).withColumn("delta", (a * y - b * x) / det)


def reading_line(rows: DataFrame, task: str = "task", pos: str = "seq", trust: str = "trust", own: str = "own_prob", label: str = "read_correct", prior: tuple[float, float] = (0.5, 0.0), precision: float = 1.0, block: int = 100_000) -> DataFrame:
    """Add rho, delta, the value of reading, and whether to read, from strictly earlier events of the task."""
    out = _solve(earlier_sums(rows, [task], pos, _terms(trust, own, label), block), prior, precision).drop(*_SUMS)
    out = out.withColumn("value", read_value(F.col(trust), F.col(own), F.col("rho"), F.col("delta")))
    return out.withColumn("reads", F.col("value") >= F.col(own))


def final_lines(rows: DataFrame, task: str = "task", trust: str = "trust", own: str = "own_prob", label: str = "read_correct", prior: tuple[float, float] = (0.5, 0.0), precision: float = 1.0) -> DataFrame:
    """By task: events, rho, delta after the last event, mean own estimate, switch point and when reading wins there."""
    terms = rows.withColumns(_terms(trust, own, label))
    sums = terms.groupBy(task).agg(F.count("*").alias("events"), F.avg(own).alias("mean_own_prob"), *[F.sum(n).alias(n) for n in _SUMS])
    out = _solve(sums, prior, precision).drop(*_SUMS)
    args = (F.col("mean_own_prob"), F.col("rho"), F.col("delta"))
    return out.withColumn("switch", switch_point(*args)).withColumn("wins", reads_when(*args))


def combined(lines: DataFrame, read_label: str = "read_correct", alone_label: str = "alone_correct") -> DataFrame:
    return lines.withColumn("correct", F.when(F.col("reads"), F.col(read_label)).otherwise(F.col(alone_label)))


def trust_bands(rows: DataFrame, trust: str = "trust", bands: int = 5, read_label: str = "read_correct", alone_label: str = "alone_correct") -> DataFrame:
    band = F.least(F.lit(bands - 1), F.floor(F.col(trust) * bands).cast("int"))
    n = lambda c: F.sum(c.cast("long")).alias
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("events"), n(F.col("reads"))("reads_total"), n(F.col(read_label))("read_rights"), n(F.col(alone_label))("alone_rights"), n(F.col("correct"))("rights"))


def combination_metrics(rows: DataFrame, read_label: str = "read_correct", alone_label: str = "alone_correct") -> DataFrame:
    share = lambda c, name: (F.sum(c.cast("long")).cast("double") / F.greatest(F.lit(1), F.count("*")).cast("double")).alias(name)
    read, alone, took = F.col(read_label), F.col(alone_label), F.col("reads")
    case = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return rows.agg(
        F.count("*").alias("events"), share(took, "share_read"), share(read, "read_accuracy"), share(alone, "alone_accuracy"), share(F.greatest(read, alone), "either_right"), share(F.col("correct"), "accuracy"),
        case((read == 1) & (alone == 0)).alias("read_cases"), case((read == 1) & (alone == 0) & took).alias("read_picked"), case((alone == 1) & (read == 0)).alias("alone_cases"), case((alone == 1) & (read == 0) & ~took).alias("alone_picked"),
    )
