import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.operators import arbitration, record
from veritally.sources import jsonl
from veritally.streaming import folds


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_events_and_answers(spark, tmp_path):
    lines(tmp_path / "e.jsonl", [{"id": "a", "problem": "x", "context": "c", "peer_responses": {"peer_1": "q", "peer_0": "p"}, "peer_correct": {"peer_0": 0.5, "peer_1": 0.6}}, "", {"uid": "b", "task_type": "RAG", "question": "y", "context": [["t", ["s1", "s2"]], "z"], "aliases": ["k"], "peer_responses": {"peer_0": "r"}, "correctness_by_peer": {"peer_0": 1}, "peer_correct": {"peer_0": 0.2}}])
    events = jsonl.read_events(spark, str(tmp_path / "e.jsonl"))
    got = {r.id: r for r in events.collect()}
    assert (got["a"].seq, got["b"].seq) == (0, 1) and got["a"].task_type == "math" and got["b"].task_type == "rag"
    assert got["a"].context == ["c"] and got["b"].context == ["t: s1 s2", "z"] and got["b"].problem == "y" and got["b"].answer_aliases == ["k"]
    answers = {(r.id, r.peer): (r.slot, r.soft, r.hard) for r in jsonl.long_answers(events).collect()}
    assert answers == {("a", "peer_0"): (0, 0.5, 0), ("a", "peer_1"): (1, 0.6, 1), ("b", "peer_0"): (0, 0.2, 1)}


def test_shards_last_wins_and_resume(spark, tmp_path):
    lines(tmp_path / "s" / "shard0.jsonl", [{"id": "a", "response": "old", "correct": 0}, "{broken", {"id": "b", "response": "only", "correct": 1}])
    lines(tmp_path / "s" / "shard1.jsonl", [{"id": "a", "response": "new", "correct": 1}])
    rows = jsonl.read_answers(spark, str(tmp_path / "s" / "shard*.jsonl"))
    assert {r.id: r.response for r in rows.collect()} == {"a": "new", "b": "only"}
    assert {r.id for r in jsonl.read_completed(spark, str(tmp_path / "s")).collect()} == {"a", "b"}
    jsonl.append(rows.select("id", "correct"), str(tmp_path / "out"))
    jsonl.append(rows.select("id", "correct"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    jsonl.write_by_peer(rows.withColumn("peer", F.lit("p")), str(tmp_path / "by"))
    assert (tmp_path / "by" / "peer=p").is_dir()
    assert jsonl.file_checksums(spark, str(tmp_path / "s" / "*.jsonl")).count() == 2
    placed = rows.withColumn("k", F.when(F.col("id") == "a", 0).otherwise(1))
    assert jsonl.ordered_digest(placed, "k", ["id", "correct"]) == jsonl.ordered_digest(placed.orderBy(F.desc("k")), "k", ["id", "correct"])
    assert jsonl.ordered_digest(placed, "k", ["id", "correct"]) != jsonl.ordered_digest(placed.withColumn("k", 1 - F.col("k")), "k", ["id", "correct"])


def test_events_of_several_files_are_in_the_files_order(spark, tmp_path):
    """The largest file comes last by name; Spark would pack it first."""
    sizes = {"a": 3, "b": 40, "c": 700}
    for name, n in sizes.items():
        lines(tmp_path / "many" / f"{name}.jsonl", [{"id": f"{name}{k:03}", "problem": "x" * 200} for k in range(n)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = [f"{name}{k:03}" for name, n in sizes.items() for k in range(n)]
    for most in ("16k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        got = jsonl.read_events(spark, str(tmp_path / "many")).select("seq", "id").orderBy("seq").collect()
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert [(r.seq, r.id) for r in got] == list(enumerate(want))


def test_results_are_published_whole_and_kept(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = str(tmp_path / "kept")
    assert jsonl.derived(spark, path, make).count() == jsonl.derived(spark, path, make).count() == 3 and made == [1]
    jsonl.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "kept.part").exists()
    jsonl.write_graded(spark.range(2), spark.range(1), str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run" / "metrics")).count() == 1
    assert jsonl.read_if_there(spark, str(tmp_path / "nowhere"), "id string").count() == 0


def test_verdicts_generations_and_labels(spark, tmp_path):
    lines(tmp_path / "v" / "shard0.jsonl", [{"id": 7, "verdicts": ["ACCEPT", "REJECT"], "critiques": ["", "short"]}, {"id": 7, "verdicts": ["REJECT", "REJECT"]}])
    assert [(r.id, r.verdicts) for r in jsonl.read_verdicts(spark, str(tmp_path / "v")).collect()] == [("7", ["REJECT", "REJECT"])]
    lines(tmp_path / "g.jsonl", [{"id": 7, "generation": "x", "correct": 1}])
    assert jsonl.read_generations(spark, str(tmp_path / "g.jsonl")).first().id == "7"
    lines(tmp_path / "l.jsonl", [{"id": "a", "task_type": "boolqa", "answer": "yes", "peer_responses": {"p0": "Final answer: yes", "p1": "no"}}, {"id": "b", "task_type": "boolqa", "answer": "yes", "peer_responses": {"p0": "no"}, "peer_correct": {"p0": 0.25}}])
    got = {r.id: r.peer_correct for r in jsonl.with_labels(jsonl.read_events(spark, str(tmp_path / "l.jsonl"))).collect()}
    assert got == {"a": {"p0": 1.0, "p1": 0.0}, "b": {"p0": 0.25}}


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_equal_batches_for_any_split(spark, tmp_path, parts):
    rng = np.random.default_rng(parts)
    rows = [(f"t{k % 2}", k // 2, rng.normal(size=2).tolist(), [int(v) for v in rng.integers(0, 2, 2)], round(float(rng.random()), 4), round(float(rng.random()), 4), int(rng.integers(2))) for k in range(24)]
    schema = "task string, pos long, address array<double>, labels array<int>, trust double, own_prob double, read_correct int"
    every = spark.createDataFrame(rows, schema)
    order = rng.permutation(24)
    for part in range(parts):  # rows come out of order, over several files
        spark.createDataFrame([rows[int(k)] for k in order[part::parts]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(stream, name):
        query = stream.writeStream.format("memory").queryName(f"{name}{parts}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return {(r.task, r.pos): r for r in spark.table(f"{name}{parts}").collect()}

    got = run(folds.record_stream(live, "task", 2, 2), "rec")
    want = record.fold(every.withColumnRenamed("pos", "seq"), "task").collect()
    assert len(got) == 24
    for r in want:
        assert got[r.task, r.seq].mean == pytest.approx(r.mean)
    got = run(folds.arbitration_stream(live), "arb")
    for r in arbitration.reading_line(every, pos="pos").collect():
        assert (got[r.task, r.pos].rho, got[r.task, r.pos].delta) == pytest.approx((r.rho, r.delta), abs=1e-9)


def test_event_time_windows(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b"), ("2024-01-02 00:00:00", "a")], "ts string, k string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    query = folds.windowed_counts(live, "ts", ["k"]).writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.events for r in spark.table("win").collect()) == [1, 1, 2]
    assert folds.sessions(spark.read.parquet(str(tmp_path / "in")), "ts", "k").count() == 4
