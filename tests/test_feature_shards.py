"""The data source of feature shards: round trips, order, checks, pruning, unfinished writes."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.operators import joins, record
from veritally.sources import feature_shards


@pytest.fixture(scope="module")
def shards(spark):
    feature_shards.register(spark)
    return spark


def features(spark, n=60):
    rng = np.random.default_rng(2)
    f = lambda *shape: rng.standard_normal(shape).astype(np.float32).astype(float).tolist()
    return spark.createDataFrame([(k, f"e{k}", f(3), f(2), f(2, 4), f(2)) for k in range(n)], feature_shards.SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_round_trip_in_any_order(shards, tmp_path):
    df = features(shards)
    df.repartition(5).write.format("feature_shards").mode("append").save(str(tmp_path / "f"))
    back = shards.read.format("feature_shards").load(str(tmp_path / "f"))
    assert back.rdd.getNumPartitions() == len(json.loads((tmp_path / "f" / "shards.json").read_text())) == 5
    assert rows(back) == rows(df)
    more = df.withColumns({"seq": F.col("seq") + 100, "id": F.concat("id", F.lit("b"))})
    more.coalesce(1).write.format("feature_shards").mode("append").save(str(tmp_path / "f"))
    assert rows(shards.read.format("feature_shards").load(str(tmp_path / "f"))) == rows(df.union(more))
    more.coalesce(2).write.format("feature_shards").mode("overwrite").save(str(tmp_path / "f"))
    assert rows(shards.read.format("feature_shards").load(str(tmp_path / "f"))) == rows(more)
    assert len([x for x in os.listdir(tmp_path / "f") if x.endswith(".npz")]) <= 2
    df.limit(0).write.format("feature_shards").mode("append").save(str(tmp_path / "none"))
    assert shards.read.format("feature_shards").load(str(tmp_path / "none")).count() == 0


def test_shards_that_cannot_hold_the_places_are_not_read(shards, tmp_path):
    df = features(shards)
    df.repartitionByRange(6, "seq").write.format("feature_shards").mode("append").save(str(tmp_path))
    index = json.loads((tmp_path / "shards.json").read_text())
    for s in index:  # what is not asked for cannot even be opened
        if s["last"] < 30:
            (tmp_path / s["file"]).write_bytes(b"broken")
    read = lambda **o: shards.read.format("feature_shards").options(**o).load(str(tmp_path))
    assert rows(read(first=30)) == rows(df.filter("seq >= 30")) and rows(read(first=35, last=40)) == rows(df.filter("seq BETWEEN 35 AND 40"))
    assert read(first=1000).count() == 0
    assert rows(read().filter("seq >= 30 AND seq < 50")) == rows(df.filter("seq >= 30 AND seq < 50"))
    assert rows(read().filter("seq IN (31, 59)")) == rows(df.filter("seq IN (31, 59)")) and read().filter("seq = 44").first().id == "e44"
    with pytest.raises(Exception, match="zip|broken|BadZip|pickle|magic"):
        read().collect()


def save(path, name, n=3, first=0, **other):
    arrays = {"places": np.arange(first, first + n), "ids": np.array([f"e{k}" for k in range(first, first + n)]), "question": np.ones((n, 3)), "meaning": np.ones((n, 2)), "answers": np.ones((n, 2, 4)), "margins": np.ones((n, 2))} | other
    np.savez(path / name, **{k: v for k, v in arrays.items() if v is not None})


def test_shards_without_an_index_and_their_faults(shards, tmp_path):
    read = lambda **o: shards.read.format("feature_shards").options(**o).load(str(tmp_path))
    with pytest.raises(Exception, match="no feature shards"):
        read().collect()
    save(tmp_path, "shard1.npz", first=3)
    save(tmp_path, "shard0.npz")
    assert [r.seq for r in read().orderBy("seq").collect()] == list(range(6)) and read(first=2, last=4).count() == 3
    for name, fault in {"question": np.ones((3, 9)), "ids": np.array(["a", "", "c"]), "places": np.array([7, 7, 8]), "margins": np.ones((2, 2)), "meaning": None}.items():
        save(tmp_path, "shard2.npz", first=6, **{name: fault})
        with pytest.raises(Exception, match="shard2.npz"):
            read().collect()
    os.remove(tmp_path / "shard2.npz")
    save(tmp_path, "shard0.npz", answers=None, margins=None)
    save(tmp_path, "shard1.npz", first=3, answers=None, margins=None)
    with pytest.raises(Exception, match="without the answers"):
        read().collect()
    assert {(r.answers, r.margins) for r in read(answers="false").collect()} == {(None, None)}


def test_a_write_that_fails_changes_nothing(shards, tmp_path):
    df = features(shards)
    df.coalesce(2).write.format("feature_shards").mode("append").save(str(tmp_path))
    before = sorted(os.listdir(tmp_path))
    failing = df.repartition(3).withColumn("id", F.when(F.col("seq") == 50, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        failing.write.format("feature_shards").mode("overwrite").save(str(tmp_path))
    assert rows(shards.read.format("feature_shards").load(str(tmp_path))) == rows(df)
    other = df.withColumn("question", F.array(F.lit(1.0).cast("float")))
    with pytest.raises(Exception, match="same columns"):
        other.write.format("feature_shards").mode("append").save(str(tmp_path))
    assert rows(shards.read.format("feature_shards").load(str(tmp_path))) == rows(df) and set(before) <= set(os.listdir(tmp_path))


def test_a_record_from_shards_is_that_from_the_frame(shards, tmp_path):
    df = features(shards)
    df.repartition(4).write.format("feature_shards").mode("append").save(str(tmp_path))
    events = shards.range(60).select(F.col("id").alias("seq"), F.concat(F.lit("e"), F.col("id")).alias("id"), F.array(F.lit(1), (F.col("id") % 2).cast("int")).alias("labels"))

    def walked(features):
        stream = joins.feature_stream(features, events).select(F.lit(0).alias("run"), F.col("seq").alias("pos"), "id", F.col("question").alias("q"), F.col("answers").alias("c"), "margins", F.lit(2).alias("real"), "labels")
        return rows(record.record_walk(stream, "run", 2))

    assert walked(shards.read.format("feature_shards").load(str(tmp_path))) == walked(df)
    wrong = events.withColumn("id", F.when(F.col("seq") == 7, F.lit("other")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="of another event"):
        joins.feature_stream(shards.read.format("feature_shards").load(str(tmp_path)), wrong).collect()
