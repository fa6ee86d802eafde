"""Streams of events: adding answers, shards, resuming, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_answers(events: DataFrame, answers: DataFrame, peers: list[str], event: str = "id") -> DataFrame:
    """Events that every added peer has answered, with a map entry a peer: `responses` and `labels`.

    `answers` is long: (event, peer, response, correct). Of several answers of a peer to an event the greatest (response, then
    label) counts. It is folded to one row an event before the join.
    """
    one = answers.filter(F.col("peer").isin(*peers)).groupBy(event, "peer").agg(F.max(F.struct("response", "correct")).alias("_a"))
    chosen = one.groupBy(event).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("peer", "_a.response")))).alias("responses"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("peer", "_a.correct")))).alias("labels"),
        F.count("*").alias("_n"),
    )
    return events.join(chosen.filter(F.col("_n") == len(set(peers))).drop("_n"), event)


def missing_answers(events: DataFrame, answers: DataFrame, peers: list[str], event: str = "id") -> DataFrame:
    """Events each peer has not answered, counted."""
    have = answers.filter(F.col("peer").isin(*peers)).select(event, "peer").distinct().groupBy("peer").agg(F.count("*").alias("_have"))
    names = events.sparkSession.createDataFrame([(p,) for p in peers], "peer string")
    return names.join(have, "peer", "left").select("peer", (F.lit(events.count()) - F.coalesce("_have", F.lit(0))).cast("long").alias("dropped"))


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the last in the given order (columns in order of importance)."""
    rest = [c for c in rows.columns if c != key]
    out = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return out.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def pending(events: DataFrame, done: DataFrame, event: str = "id") -> DataFrame:
    """Events whose id has not been written yet."""
    return events.join(done.select(event), event, "left_anti")


def merge_shards(shards: list[DataFrame]) -> DataFrame:
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out


def content_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and an order-free digest: the sum (mod 2^32) and the exclusive or of 32 bits of each row's sha256."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 8), 16, 10).cast("long")
    return rows.select(bits.alias("b")).agg(F.count("*").alias("events"), (F.sum("b") % F.lit(1 << 32)).cast("long").alias("digest_sum"), F.bit_xor("b").cast("long").alias("digest_xor"))
