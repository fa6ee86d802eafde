"""The record over event time: out of order, late, over a restart, forgotten."""

import datetime
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.operators import record
from veritally.streaming import timed_record

START = datetime.datetime(2024, 1, 1)
SCHEMA = "id string, k string, ts timestamp, address array<double>, labels array<int>"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, timed_record.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def event(k, key, minute, rng):
    return {"id": f"e{k:03}", "k": key, "ts": (START + datetime.timedelta(minutes=minute)).isoformat(), "address": [round(float(x), 3) for x in rng.standard_normal(2)], "labels": [int(x) for x in rng.integers(0, 2, 2)]}


def batch(folder, number, rows):
    folder.mkdir(exist_ok=True)
    part = folder / f".{number:03}.json"
    part.write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(part, (1_700_000_000 + number,) * 2)  # files are taken in the order of their times
    part.rename(folder / f"{number:03}.json")


def run(spark, tmp_path, **options):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = timed_record.record_in_time(events, "k", "ts", 2, 2, late="30 minutes", **options)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return {(r.k, r.id): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}, q


def walked(spark, rows):
    df = spark.createDataFrame([(r["id"], r["k"], r["ts"], r["address"], r["labels"]) for r in rows], "id string, k string, ts string, address array<double>, labels array<int>")
    df = df.withColumn("order", F.concat("ts", "id"))
    return {(r.k, r.order[-4:]): r for r in record.fold(df, "k", "order").collect()}


def test_events_out_of_order_late_and_over_a_restart(rocks, tmp_path):
    rng, shuffle = np.random.default_rng(5), random.Random(5)
    rows = [event(k, "ab"[k % 2], 3 * (k // 2), rng) for k in range(60)]  # two keys, an event each every three minutes
    near = sorted(rows, key=lambda r: (datetime.datetime.fromisoformat(r["ts"]) - START).seconds / 60 + shuffle.uniform(-12, 12))
    batches = [near[k : k + 12] for k in range(0, 60, 12)]
    for k in range(3):
        batch(tmp_path / "in", k, batches[k])
    first, q = run(rocks, tmp_path)
    assert 0 < len(first) < 36
    # what waits is within the lateness, not the history
    waiting = [p["numRowsTotal"] for s in q.recentProgress for p in s["stateOperators"]]
    assert waiting and max(waiting) < 150
    late = event(900, "a", 0, rng)  # long past the watermark
    batch(tmp_path / "in", 3, [*batches[3], late, batches[2][0]])
    batch(tmp_path / "in", 4, batches[4])
    batch(tmp_path / "in", 5, [event(990, "z", 1000, rng)])
    batch(tmp_path / "in", 6, [event(991, "z", 1001, rng)])
    got, _ = run(rocks, tmp_path)
    want = walked(rocks, rows)
    got = {k: r for k, r in got.items() if k[0] != "z"}
    assert set(got) == set(want) and ("a", "e900") not in got
    for k, r in want.items():
        assert np.allclose(got[k].mean, r.mean) and np.isclose(got[k].variance, r.variance) and np.allclose(got[k].probability, r.probability)


def test_a_key_of_which_nothing_comes_is_forgotten(rocks, tmp_path):
    rng = np.random.default_rng(6)
    early, again = [event(k, "a", k, rng) for k in range(4)], [event(k, "a", 600 + k, rng) for k in range(10, 13)]
    far = lambda n: [event(n, "z", 10 * n, rng)]
    for n, rows in enumerate([early, far(50), far(51), again, far(100), far(101)]):
        batch(tmp_path / "in", n, rows)
    got, _ = run(rocks, tmp_path, forget_seconds=3600)
    want = walked(rocks, early) | walked(rocks, again)
    assert {k for k in got if k[0] == "a"} == set(want)
    assert all(np.allclose(got[k].mean, r.mean) and np.isclose(got[k].variance, r.variance) for k, r in want.items())
