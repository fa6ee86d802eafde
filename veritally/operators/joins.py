"""Joins of a record's parts: features, answers, generations, flags, histories, verdicts; and who is shown, in what order.

Every join is an equi-join on an id or a place. Where a row must have a partner, the check is part of the projection: the job
fails with the row's id as it is written, and nothing is counted or collected beforehand.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered

FEATURES = "seq long, id string, question array<float>, meaning array<float>, answers array<array<float>>, margins array<float>"


def checked(value: Column, wrong: Column, *message) -> Column:
    """The value, or an error with the message where `wrong` holds."""
    text = F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message])
    return F.when(wrong, F.raise_error(text)).otherwise(value)


def feature_stream(features: DataFrame, events: DataFrame) -> DataFrame:
    """Features (see FEATURES; shards in any order) with their events, by place in the stream; an id that differs is an error.

    Events without features are left out: the features say which events there are.
    """
    own = events.select(F.col("seq"), F.col("id").cast("string").alias("_event"), *[c for c in events.columns if c not in ("seq", "id")])
    both = features.join(own, "seq", "left")
    differs = F.col("_event").isNull() | (F.col("_event") != F.col("id"))
    return both.withColumn("id", checked(F.col("id"), differs, "features of ", F.col("id"), ", place ", F.col("seq").cast("string"), ", are of another event: ", F.coalesce("_event", F.lit("none")))).drop("_event")


def subset(stream: DataFrame, places: DataFrame) -> DataFrame:
    """The events at the places of a table (seq, pos), with their new place `pos`; a place may come more than once."""
    return stream.join(places.select("seq", "pos"), "seq")


def consulted_events(stream: DataFrame, real: str = "real", own: int | None = None) -> DataFrame:
    """Events with an answer; with an own slot, one that has no answer there is an error."""
    some = stream.filter(F.col(real) >= 1)
    if own is None:
        return some
    return some.withColumn(real, checked(F.col(real), F.col(real) <= own, "event ", F.col("id").cast("string"), " has ", F.col(real).cast("string"), " answers, so none in slot ", str(own)))


def slot_permutation(stream: DataFrame, pos: str = "pos", real: str = "real", own: int | None = None, seed: int = 0, name: str = "peer_order") -> DataFrame:
    """Add the order in which an event's answers are shown: the slots without the own one, shuffled.

    The k-th event that has an answer, in the order of `pos`, has the k-th number below 2 ** 30 of the seeded generator as the
    seed of its shuffle. The generator jumps to a row's number, so rows need no common task.
    """
    rows = numbered(consulted_events(stream, real, own), [pos], "_k")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields if f.name != '_k')}, {name} array<int>"

    def run(batches):
        for batch in batches:
            orders = []
            for k, r in zip(batch.column("_k").to_pylist(), batch.column(real).to_pylist(), strict=True):
                shown = [s for s in range(r) if s != own]
                random.Random(event_seed(seed, k)).shuffle(shown)
                orders.append(shown)
            kept = [n for n in batch.schema.names if n != "_k"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(orders, pa.list_(pa.int32()))], [*kept, name])

    return rows.mapInArrow(run, schema)


def event_seed(seed: int, k: int) -> int:
    """The k-th (from 0) of the numbers below 2 ** 30 that a generator seeded with `seed` gives.

    Each takes the upper 30 bits of half a step of the generator, low half first.
    """
    bits = np.random.PCG64(seed)
    bits.advance(k // 2)
    step = int(bits.random_raw())
    return (step >> 32 if k % 2 else step & 0xFFFFFFFF) >> 2


def no_record_rows(events: DataFrame, walk: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows of a run without a record: (pos, id, task_type, source, peer_correct). The first `limit` events of the file
    are taken before they are walked; labels are rounded with halves to even, in the order of the sources' names."""
    first = events if limit is None else events.filter(F.col("seq") < limit)
    labels = F.coalesce(F.col("correctness_by_peer").cast("map<string,double>"), F.col("peer_correct"))
    ordered = F.transform(F.array_sort(F.map_keys(labels)), lambda k: F.bround(F.try_element_at(labels, k)).cast("int"))
    rows = first.join(walk.select("seq", "pos"), "seq")
    return rows.select("pos", F.col("id").cast("string").alias("id"), F.coalesce("task_type", F.lit("")).alias("task_type"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce(ordered, F.array().cast("array<int>")).alias("peer_correct"))


def with_generations(record: DataFrame, peers_memory: DataFrame, question_alone: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Record rows with both answers of the model: read_correct, read_generation, alone_correct, alone_generation.

    An event without one of them is an error, or left out with skip_missing (see `without_generations`).
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("id").cast("string").alias("id"), F.col("correct").cast("int").alias(f"{name}_correct"), F.col("generation").alias(f"{name}_generation"))

    record = record.withColumn("id", F.col("id").cast("string"))
    how = "inner" if skip_missing else "left"
    both = record.join(side(peers_memory, "read"), "id", how).join(side(question_alone, "alone"), "id", how)
    if skip_missing:
        return both
    for name, said in (("read", "no answer beside the sources"), ("alone", "no answer of its own")):
        both = both.withColumn(f"{name}_correct", checked(F.col(f"{name}_correct"), F.col(f"{name}_correct").isNull(), "event ", F.col("id"), f" has {said}"))
    return both


def without_generations(record: DataFrame, peers_memory: DataFrame, question_alone: DataFrame) -> DataFrame:
    """Record rows that lack one of the answers."""
    ids = lambda df: df.select(F.col("id").cast("string").alias("id"))
    record = record.withColumn("id", F.col("id").cast("string"))
    return record.join(ids(peers_memory).intersect(ids(question_alone)), "id", "left_anti")


def with_flags(record: DataFrame, flags: DataFrame, name: str = "misled") -> DataFrame:
    """Record rows with the flags of the answers they show, in the order shown; events without flags are left out.

    `flags` has (id, flags array<boolean>) by slot, record rows have peer_order.
    """
    found = record.join(flags.select("id", F.col("flags").alias("_flags")), "id")
    return found.withColumn(name, F.transform("peer_order", lambda p: F.get("_flags", p))).drop("_flags")


def with_history(rows: DataFrame, previous: DataFrame, round_: int) -> DataFrame:
    """Rows with what the model said so far: `history` of the round before, or its only answer. Each event must have an answer,
    and as many as the round needs."""
    before = previous.select("id", F.coalesce(F.col("history") if "history" in previous.columns else F.lit(None).cast("array<string>"), F.array("generation")).alias("history"))
    both = rows.drop("history").join(before, "id", "left")
    missing, n = F.col("history").isNull(), F.size("history")
    history = checked(F.col("history"), ~missing & (n != round_), "event ", F.col("id").cast("string"), " has ", n.cast("string"), f" answers; round {round_} needs {round_}")
    return both.withColumn("history", F.when(missing, F.raise_error(F.concat(F.lit("event "), F.col("id").cast("string"), F.lit(" has no answer in the round before")))).otherwise(history))


def rejections(stream: DataFrame, verdicts: DataFrame, sources: int) -> DataFrame:
    """(id, source, rejected) for the first `sources` of every event of the stream; an event without verdicts is an error."""
    both = stream.select("id").join(verdicts.select("id", "verdicts"), "id", "left")
    said = checked(F.col("verdicts"), F.col("verdicts").isNull() | (F.size("verdicts") < sources), "event ", F.col("id").cast("string"), f" has no verdicts on {sources} reports")
    return both.select("id", F.posexplode(F.slice(said, 1, sources)).alias("source", "verdict")).select("id", "source", (F.col("verdict") == "REJECT").cast("int").alias("rejected"))


def described_peers(peers: DataFrame, models: DataFrame) -> DataFrame:
    """Sources (index, tag, model, and settings of their own) with their model's settings, which theirs go before."""
    own = [c for c in peers.columns if c not in ("index", "tag", "model")]
    theirs = [c for c in models.columns if c != "model"]
    both = peers.join(models.select("model", *[F.col(c).alias(f"_m_{c}") for c in theirs]), "model", "left")
    return both.select("index", "tag", "model", *[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) if c in theirs else F.col(c) for c in own], *[F.col(f"_m_{c}").alias(c) for c in theirs if c not in own])


def from_sources(rows: DataFrame, sources: list[str], column: str = "source") -> DataFrame:
    """Rows of the named sources; no name keeps all."""
    return rows.filter(F.col(column).isin(sources)) if sources else rows


def chose_to_read(choice: Column) -> Column:
    """Whether a stored choice was to read the sources."""
    return F.regexp_like(F.lower(F.coalesce(choice, F.lit(""))), F.lit("peers|memory"))


def length_batches(rows: DataFrame, length: str, size: int, seq: str = "seq") -> DataFrame:
    """Add the batch of each row when rows are batched by length, so that rows of a batch are alike; `seq` gives the order back."""
    out = numbered(rows, [length, seq], "_n")
    return out.withColumn("batch", F.floor(F.col("_n") / size).cast("long")).drop("_n")


def chosen_layers(count: Column) -> Column:
    """A third, two thirds and the last of the layers, each once."""
    one = lambda c: F.greatest(F.lit(1), F.floor(c).cast("int"))
    return F.array_sort(F.array_distinct(F.array(one(count / 3), one(2 * count / 3), (count - 1).cast("int"))))


def token_values(tokens: DataFrame, spans: DataFrame, id_: str = "id") -> DataFrame:
    """Tokens (id, token, start, end) with the value of the span (id, start, end, value) that they lie in, else 0; of several
    the last by `span`. Empty tokens and empty spans count for nothing."""
    s = spans.filter((F.col("end") > F.col("start")) & (F.col("value") != 0)).groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("span", "start", "end", "value"))).alias("_spans"))
    inside = F.filter("_spans", lambda x: (F.col("end") > F.col("start")) & (F.col("start") >= x["start"]) & (F.col("end") <= x["end"]))
    both = tokens.join(s, id_, "left")
    return both.withColumn("value", F.coalesce(F.get(F.transform(F.slice(inside, -1, 1), lambda x: x["value"]), F.lit(0)), F.lit(0.0))).drop("_spans")
