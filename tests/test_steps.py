import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.__main__ import main
from veritally.operators import addresses
from veritally.plans import steps, tables
from veritally.plans.planner import Plan, Runner
from veritally.plans.registry import Registry

from .test_planner import ENTITIES


def answers(spark, path, label, accepted=True):
    spark.range(40).select(F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit(f"{label} "), "id").alias("response"), F.lit(label == "right").cast("int").alias("correct"), F.lit(accepted).alias("accepted"), (F.col("id") % 4 == 0).alias("forced")).write.parquet(path)


def test_streams_own_answers_and_tables(spark, tmp_path):
    root = str(tmp_path)
    conditions = {"tilt": {"mode": "peers"}, "solo": {"mode": "solo"}}
    entities = {**ENTITIES, "datasets": {**ENTITIES["datasets"], "half": {"kind": "misleading", "base": "base", "answers": "bad", "regime": "p050", "drop_forced": True}}}
    plan = Plan({"name": "e", "central": ["m1"], "datasets": ["half"], "own_answer": True, "conditions": conditions, "steps": ["streams", "own", "combination", "table"], "eval_conditions": ["tilt"]}, Registry(entities), root)
    events = spark.range(40).select(F.col("id").alias("seq"), F.concat(F.lit("e"), "id").alias("id"), F.lit("boolqa").alias("task_type"))
    for p in ("p0", "p1"):
        answers(spark, f"{root}/honest/{p}", "right")
        answers(spark, plan.layout.answers("bad", p), "wrong")
    base = steps.add(events, steps.answers_of(spark, (f"{root}/honest/p0", f"{root}/honest/p1")), 2)
    assert base.count() == 80 and steps.add(events, steps.answers_of(spark, (f"{root}/honest/p0",)), 2).count() == 0
    base.write.parquet(plan.layout.stream("base"))
    said = events.select("id", (F.col("seq") % 2).cast("int").alias("correct"), F.lit("mine").alias("generation"))
    said.write.parquet(plan.layout.evaluation("m1", "base", "solo"))
    done = Runner(spark, steps.STEPS).run(plan, ["streams", "own"])
    assert done == {"streams-half": "ran", "own-m1-base-solo": "kept", "own-m1-half": "ran"}
    half = spark.read.parquet(plan.layout.stream("half"))
    counts = {r["slot"]: r["n"] for r in half.filter("misled").groupBy("slot").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 20, 1: 20} and half.filter("misled AND (forced OR correct = 1 OR response LIKE 'right%')").count() == 0
    manifest = [json.loads(x) for f in (tmp_path / "streams").glob("half.manifest/*.json") for x in f.read_text().splitlines()]
    assert sorted((m["peer"], m["rights_before"], m["rights_after"], m["misled_answers"]) for m in manifest) == [("p0", 40, 20, 20), ("p1", 40, 20, 20)]
    assert spark.read.parquet(plan.layout.own_stream("m1", "half")).filter("slot = 2 AND peer = 'own' AND response = 'mine'").count() == 40
    said.write.parquet(plan.layout.evaluation("m1", "half", "tilt"))
    events.select("id", "seq", F.lit("boolqa").alias("task"), F.lit(0.75).alias("trust"), F.lit(0.5).alias("own_prob")).write.parquet(plan.layout.record("m1", "half"))
    assert Runner(spark, steps.STEPS).run(plan, ["combination", "table"]) == {"combination-m1-half": "ran", "table": "ran"}
    assert spark.read.parquet(plan.layout.evaluation("m1", "half", "combination")).count() == 40
    shown = [r.asDict() for r in spark.read.parquet(plan.layout.result_table("e")).orderBy("stream").collect()]
    assert [r["stream"] for r in shown] == ["base", "half+own"] and shown[0]["solo"].strip() == "50.0" and shown[0]["combination"] == "-"
    with pytest.raises(ValueError, match="unknown regime"):
        steps.regime_of("x9", "n")


def test_a_replay_as_markdown(spark):
    sources = spark.createDataFrame([("a", 61.25, None), ("b", 50.0, 12.5)], "source string, accuracy double, rejected double")
    policies = spark.createDataFrame([("memory", "all", 2, 0.78, 1.3, 0.7), ("random", "none", 2, 0.5, 1.0, 0.5)], "policy string, mode string, calls int, accuracy double, worker_calls double, first_accuracy double")
    sweep = spark.createDataFrame([("memory", 1, 0.6, 1.0), ("memory", 2, 0.7, 1.3), ("random", 1, 0.5, 1.0)], "policy string, calls int, accuracy double, worker_calls double")
    text = tables.replay_report("Run", sources, policies, sweep)
    assert text.startswith("# Run\n\n| source | accuracy | rejected |") and "| a | 61.2 | - |" in text.replace("61.3", "61.2")
    assert "| memory | the dataset's check; failed: the next source | 1.30 | 78.0 | 70.0 |" in text and "| 2 | 70.0 (1.30) | None |" in text


def test_commands(tmp_path, capsys):
    for kind, found in ENTITIES.items():
        (tmp_path / "registry" / kind).mkdir(parents=True)
        for name, entity in found.items():
            (tmp_path / "registry" / kind / f"{name}.json").write_text(json.dumps(entity))
    assert main(["registry", str(tmp_path / "registry"), "--kind", "groups"]) == 0 and "groups: rates" in capsys.readouterr().out
    (tmp_path / "e.json").write_text(json.dumps({"name": "e", "central": ["m1"], "datasets": ["rates"], "steps": ["streams"], "conditions": {}}))
    assert main(["plan", str(tmp_path / "e.json"), "--registry", str(tmp_path / "registry"), "--root", "/r", "--set", 'datasets=["full"]']) == 0
    assert capsys.readouterr().out == "streams\tstreams-full\tstreams/full\tstreams/base answers/bad/p0 answers/bad/p1\n"
    with pytest.raises(SystemExit, match="no query"):
        main(["query", "none", "/nowhere"])


def test_projections_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(k, [float(k), float(k * k % 7), 1.0]) for k in range(30)], "k long, f array<double>")
    fitted = addresses.fit(df, "f", 2)
    addresses.save({"q": fitted}, spark, str(tmp_path / "p"))
    again = addresses.load(spark, str(tmp_path / "p"))["q"]
    rows = [[r.address for r in p.apply(df, "f").orderBy("k").collect()] for p in (again, fitted)]
    assert np.allclose(*rows)
    with pytest.raises(ValueError, match="no features"):
        addresses.fit(df.limit(0), "f", 2)
