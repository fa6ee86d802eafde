"""As-of joins: the last state at or before a place, by key; in blocks, so that one key's history is not one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import MOST_RANGES, _cuts_below


def _same(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, state: list[str], right_at: str | None = None, last: list[str] = (), strict: bool = False, how: str = "left", block_rows: int = 200_000) -> DataFrame:
    """Rows of `left` with the columns `state` of the last row of `right` that has the same keys and a place `right_at` at or before
    `at` (before it, if strict). Of rows of `right` at one place the one with the greatest `last` counts, then the greatest state.

    Places are numbers, dates or times. A null key or place has no state; with how="inner" rows without a state go.

    Only distinct places are ordered: states are reduced to one for each key and place, and the places that `left` asks for are taken once; rows
    that share a place meet its answer in a plain join, whose hot keys Spark splits. Places are cut at quantiles of all of them into blocks of about `block_rows`
    rows. Within a block and key a window finds the last state; the last states of the blocks before come from a table with a row for each block of a key.
    A key with most of the rows is thus as many tasks as it has blocks.
    """
    right_at = right_at or at
    key_names = [f"_k{n}" for n in range(len(by))]
    keys = lambda df, place: df.select(*[F.col(k).alias(n) for k, n in zip(by, key_names, strict=True)], F.col(place).alias("_t"))
    known = lambda df, place: df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, place]]))
    told = known(right, right_at)
    told = told.select(*[F.col(k).alias(n) for k, n in zip(by, key_names, strict=True)], F.col(right_at).alias("_t"), F.struct(*state).alias("_state"), F.struct(*[F.col(c) for c in last], *state).alias("_last"))
    states = told.groupBy(*key_names, "_t").agg(F.max_by("_state", "_last").alias("_state")).withColumn("_asks", F.lit(0))
    asked = keys(known(left, at), at).distinct().withColumns({"_state": F.lit(None).cast(states.schema["_state"].dataType), "_asks": F.lit(1)})
    rows = states.unionByName(asked)
    # dates and times as numbers, for the cuts alone
    place = F.col("_t") if rows.schema["_t"].dataType.typeName() not in ("date", "timestamp", "timestamp_ntz") else F.col("_t").cast("timestamp")
    place = place.cast("double")
    blocks = min(MOST_RANGES, max(1, -(-rows.count() // block_rows)))
    cuts = rows.select(F.percentile_approx(place, [k / blocks for k in range(1, blocks)], 100 * blocks)).first()[0] if blocks > 1 else []
    rows = rows.withColumn("_block", _cuts_below(place, sorted(set(cuts))) if cuts else F.lit(0))
    # at one place a state comes before who asks for it, or after, if strict
    turn = F.col("_asks").desc() if strict else F.col("_asks").asc()
    within = Window.partitionBy(*key_names, "_block").orderBy("_t", turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.withColumn("_here", F.last("_state", ignorenulls=True).over(within)).filter("_asks = 1").drop("_state", "_asks")
    ends = rows.groupBy(*key_names, "_block").agg(F.max_by("_state", F.when(F.col("_asks") == 0, F.col("_t"))).alias("_end"))
    before = Window.partitionBy(*key_names).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"_c{k}") for k in key_names], F.col("_block").alias("_cblock"), F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    found = here.join(carried, _same([*((k, f"_c{k}") for k in key_names), ("_block", "_cblock")]))
    found = found.select(*key_names, "_t", F.coalesce("_here", "_carried").alias("_found"))
    found = found.filter(F.col("_found").isNotNull()) if how == "inner" else found
    own = left.drop(*[c for c in state if c in left.columns and c not in by and c != at])
    met = own.join(found, reduce(lambda a, b: a & b, [own[k] == found[n] for k, n in zip([*by, at], [*key_names, "_t"], strict=True)]), how)
    return met.select(*own.columns, *[F.col(f"_found.{c}").alias(c) for c in state])
