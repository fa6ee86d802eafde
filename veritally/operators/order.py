"""Order: numbering a stream, walk orders, positions, segments, equal-count bins."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType


#: Ranges at most: what is cut, collected and broadcast has no more rows.
MOST_RANGES = 10_000


def _cuts_below(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are below the value, by halving: no cut is below null, all are below NaN."""
    every, halves = F.array(*[F.lit(c) for c in cuts]), F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def below(v):  # a name of its own, as the value would be computed anew for every step
        return F.aggregate(halves, F.lit(0), lambda at, n: F.when(F.get(every, at + n - 1) < v, at + n).otherwise(at))

    return F.get(F.transform(F.array(value), below), F.lit(0))


def _as_number(df: DataFrame, name: str) -> Column:
    """The column's values as doubles in the same order. Dates and times without a zone count from 1970 by their own calendar: a
    session's time zone repeats or skips hours, so a time of that zone could change places with another."""
    value, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, TimestampNTZType):
        day = F.unix_date(value.cast("date")).cast("double")
        return day * 86400 + F.hour(value) * 3600 + F.minute(value) * 60 + F.extract(F.lit("SECOND"), value).cast("double")
    return value.cast("double")


def numbered(df: DataFrame, order: list[str], name: str = "seq", bucket_rows: int = 200_000) -> DataFrame:
    """Add the row's number (from 0) in the order of the given columns, the first of which is a number, a date or a time.

    Rows are cut into value ranges of about bucket_rows rows; each range is numbered by itself and shifted by the sizes
    of those before, so no task sees the whole table. Cuts and sizes come to the driver: two values per range.
    """
    value = _as_number(df, order[0])
    rows = df.count()
    ranges = min(MOST_RANGES, max(1, -(-rows // bucket_rows)))
    if ranges == 1:  # what one task sorts anyway
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).cast("long"))
    cuts = df.select(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0]
    bucket = _cuts_below(value, sorted(set(cuts)))
    df = df.withColumn("_range", bucket)
    # sizes as literals: of a join with them on `_range`, Spark infers a filter on the sizes that reads the first column, which they lack
    sizes = dict(df.groupBy("_range").count().collect())
    before = F.array(*[F.lit(n).cast("long") for n in accumulate((sizes.get(k, 0) for k in range(max(sizes))), initial=0)])
    within = Window.partitionBy("_range").orderBy(*order)
    # a count of its own keeps ranges apart: by their bytes, Spark would put many in one task, with all that follows
    out = df.repartition(ranges, "_range").withColumn("_number", F.row_number().over(within))
    return out.withColumn(name, (F.get(before, F.col("_range")) + F.col("_number") - 1).cast("long")).drop("_range", "_number")


def permutation(spark, n: int, order: str, block: int = 1_000_000) -> DataFrame:
    """(seq, pos): the walk `fixed`, or `shuffledK` by a generator seeded with K.

    The shuffle is one sequence of swaps, so it is made in one task, of n whole numbers (8 bytes each); they leave it in Arrow
    batches and never pass through the driver.
    """
    if order == "fixed":
        return spark.range(n).select(F.col("id").alias("seq"), F.col("id").alias("pos"))
    seed = int(order.removeprefix("shuffled"))

    def run(batches):
        for _ in batches:
            pass
        walk = np.random.default_rng(seed).permutation(n)
        for at in range(0, n, block):
            part = walk[at : at + block]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(np.arange(at, at + len(part)))], ["seq", "pos"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "seq long, pos long")


def position(pos: Column, n) -> Column:
    """Place in the walk, in [0, 1)."""
    return pos.cast("double") / F.greatest(F.lit(1) if not isinstance(n, Column) else F.lit(1).cast("long"), n if isinstance(n, Column) else F.lit(n)).cast("double")


def edges(n: int, windows: int, rule: str) -> list[int]:
    """Segment edges: `even` rounds i n / w with halves to even, `floor` cuts."""
    return [round(k * n / windows) if rule == "even" else n * k // windows for k in range(windows + 1)]


def segment(pos: Column, n: int, windows: int, rule: str = "even") -> Column:
    """The segment (from 0) of a place; empty segments are skipped over."""
    inner = F.array(*[F.lit(e).cast("long") for e in edges(n, windows, rule)[1:-1]]) if windows > 1 else F.array().cast("array<bigint>")
    return F.size(F.filter(inner, lambda e: e <= pos)).cast("int")


def equal_count_bin(number: Column, n: Column, bins: int) -> Column:
    """The bin of the number-th row (from 0) when bin i has the rows from floor(n i / bins) on."""
    return F.floor(((number + 1) * bins - 1) / n).cast("int")


def systematic(df: DataFrame, pos: str, every: int = 1, limit: int | None = None, shard: int = 0, shards: int = 1) -> DataFrame:
    """Every k-th place, then the first `limit` of them, then every shards-th from shard on."""
    kept = df.filter(F.col(pos) % every == 0)
    number = F.floor(F.col(pos) / every)
    if limit is not None:
        kept = kept.filter(number < limit)
    return kept.filter(number % shards == shard)


def grouped_order(spark, tasks: DataFrame, task: str, seed: int) -> DataFrame:
    """(task, task_pos): tasks, in the order of their first row, in a seeded permutation. `tasks` has (task, first).

    Tasks are numbered where they are and meet the permutation by their number.
    """
    places = numbered(tasks.select(task, "first"), ["first"], "seq")
    return places.join(permutation(spark, tasks.count(), f"shuffled{seed}"), "seq").select(task, F.col("pos").alias("task_pos"))
