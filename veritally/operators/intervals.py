"""Joins of intervals: which intervals hold, or meet, those of another relation; by bins of several widths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(length: Column, width: int) -> Column:
    """The least l with length <= width * 2 ** l, exactly."""
    parts = F.ceil(length / width)
    bits = F.length(F.bin((parts - 1).cast("long")))
    return F.when(parts <= 1, F.lit(0)).otherwise(bits).cast("int")


def _bin(place: Column, l: Column, width: int) -> Column:
    return F.floor(place / (F.lit(width) * F.pow(F.lit(2.0), l))).cast("long")


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], kind: str = "within", width: int = 16) -> DataFrame:
    """Pairs of rows with the same keys where the left interval lies within the right one, or overlaps it (kind="overlaps").

    Spans are (start, end) of whole numbers, ends exclusive. Empty spans (end <= start), null places and null keys meet nothing. The
    columns of both sides must differ but for the keys.

    A right interval goes to the bins of the width next above its length, width * 2 ** level, of which it touches two at most, however long it is; a left
    one looks at each level in use of its key, in the bins that its start (or, to overlap, it all) touches. So the rows made are twice the right ones, and
    the left ones times the levels in use; a key with most of the rows is spread over its bins. Every pair is checked against the exact places,
    and is found in one bin only: that of the left start, or of the right start if it is later.
    """
    a, b = left_span
    c, d = right_span
    keys_there = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in by])
    there = right.filter(keys_there & (F.col(d) > F.col(c))).withColumn("_level", level(F.col(d) - F.col(c), width))
    there = there.withColumn("_bin", F.explode(F.sequence(_bin(F.col(c), F.col("_level"), width), _bin(F.col(d) - 1, F.col("_level"), width))))
    # which levels a key has: a few numbers for each key
    levels = there.groupBy(*by).agg(F.collect_set("_level").alias("_levels"))
    asking = left.filter(keys_there & (F.col(b) > F.col(a))).join(levels, by).withColumn("_level", F.explode("_levels")).drop("_levels")
    last = F.col(b) - 1 if kind == "overlaps" else F.col(a)
    asking = asking.withColumn("_bin", F.explode(F.sequence(_bin(F.col(a), F.col("_level"), width), _bin(last, F.col("_level"), width))))
    met = asking.join(there, [*by, "_level", "_bin"])
    if kind == "within":
        met = met.filter((F.col(a) >= F.col(c)) & (F.col(b) <= F.col(d)))
    else:
        met = met.filter((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (_bin(F.greatest(a, c), F.col("_level"), width) == F.col("_bin")))
    return met.drop("_level", "_bin")


def held_values(tokens: DataFrame, spans: DataFrame, id_: str = "id", width: int = 16) -> DataFrame:
    """Tokens (id, token, start, end) with the value of the span (id, span, start, end, value) that they lie in, else 0; of several the
    last by `span`. Spans of value 0 and empty ones count for nothing; one id may have any number of tokens and spans."""
    own = tokens.select(id_, "token", F.col("start").alias("_a"), F.col("end").alias("_b"))
    there = spans.filter(F.col("value") != 0).select(id_, "span", F.col("start").alias("_c"), F.col("end").alias("_d"), F.col("value").alias("_value"))
    met = interval_join(own, there, [id_], ("_a", "_b"), ("_c", "_d"), "within", width)
    found = met.groupBy(id_, "token").agg(F.max_by("_value", "span").alias("_value"))
    out = tokens.join(found.withColumnsRenamed({id_: "_id", "token": "_token"}), F.col(id_).eqNullSafe(F.col("_id")) & (F.col("token") == F.col("_token")), "left")
    return out.select(*tokens.columns, F.coalesce("_value", F.lit(0.0)).alias("value"))
