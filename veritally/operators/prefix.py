"""Sums over all earlier rows of a key, in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def earlier_sums(df: DataFrame, keys: list[str], pos: str, sums: dict[str, Column], block: int = 100_000) -> DataFrame:
    """Add, for each name, the sum of its expression over the rows of the same keys at strictly earlier places.

    Places are numbers from 0. A key's rows are cut into blocks of `block` places, so that one key's history is not one
    task: within a block a window adds up, and the sums of the blocks before come from a table with a row a block.
    """
    df = df.withColumn("_block", F.floor(F.col(pos) / block)).withColumns({f"_x_{n}": c for n, c in sums.items()})
    totals = df.groupBy(*keys, "_block").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), *[F.sum(f"_t_{n}").over(before).alias(f"_p_{n}") for n in sums])
    within = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_w_{n}": F.sum(f"_x_{n}").over(within) for n in sums})
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = df.join(totals, same)
    zero = F.lit(0)
    out = out.withColumns({n: F.coalesce(f"_p_{n}", zero) + F.coalesce(f"_w_{n}", zero) for n in sums})
    return out.drop("_block", "_b", *[f"_{a}_{n}" for n in sums for a in "xpw"], *[f"_k_{k}" for k in keys])
