"""Distinct counts by sketches that are stored by shard and merged later, without the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers as a power of two: a relative standard error of about 0.83 / 2 ** (LG / 2), so 1.3 % at 12.
LG = 12


def error(lg: int = LG) -> float:
    return 0.83 / 2 ** (lg / 2)


def shard_sketches(df: DataFrame, by: list[str], shard: Column, value: str, lg: int = LG) -> DataFrame:
    """(by, shard, sketch) of the distinct non-null values; a sketch has at most 2 ** lg bytes or so, whatever it has seen."""
    return df.withColumn("shard", shard).groupBy(*by, "shard").agg(F.hll_sketch_agg(F.col(value), F.lit(lg)).alias("sketch"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, sketch) over all shards; merging in any order and grouping gives the same estimate."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch", F.lit(True)).alias("sketch"))


def estimated(sketches: DataFrame, name: str = "distinct") -> DataFrame:
    """The estimate in place of the sketch."""
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")
