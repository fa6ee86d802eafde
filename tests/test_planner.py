import threading

import pytest

from veritally.plans import registry
from veritally.plans.layout import Layout
from veritally.plans.planner import Plan, Runner
from veritally.plans.registry import Job, Registry, execute, leaves, load_config, nested, over

ENTITIES = {
    "models": {"m1": {"path": "models/m1", "engine": "x"}, "m2": {"path": "models/m2"}},
    "peers": {"p0": {"model": "m1"}, "p1": {"model": "m2", "tool": "search", "engine": "y"}},
    "datasets": {
        "base": {"kind": "stream", "peers": ["p0", "p1"], "views": {"search": {"path": "base_search", "context": False}}},
        "bad": {"kind": "answers", "base": "base", "mode": "misleading"},
        "half": {"kind": "misleading", "base": "base", "answers": "bad", "regime": "fraction:0.5"},
        "full": {"kind": "misleading", "base": "base", "answers": "bad", "regime": "fraction:1"},
    },
    "groups": {"rates": {"members": ["base", "half", "full"]}},
}
CONDITIONS = {"tilt": {"mode": "peers", "gamma": 3.0}, "solo": {"mode": "solo"}, "d1": {"mode": "debate", "round": 1}, "d2": {"mode": "debate", "round": 2, "previous": "d1"}, "vote": {"mode": "vote", "own": "solo"}}


def plan(**more):
    settings = {"name": "e", "central": ["m1"], "datasets": ["rates"], "conditions": CONDITIONS, "steps": ["peers", "streams", "features", "record", "evaluate", "vote", "table"], "eval_conditions": ["tilt", "solo", "d1", "d2"], "vote_conditions": ["vote"], **more}
    return Plan(settings, Registry(ENTITIES), "/data/x/", more.pop("smoke_run", False))


def test_needs_follow_from_what_is_read_and_made():
    jobs = {j.name: j for j in plan().jobs(lambda w: None)}
    assert jobs["streams-half"].needs == ("peers-bad-p0", "peers-bad-p1")
    assert jobs["record-m1-half"].needs == ("streams-half", "features-m1-half")
    assert jobs["evaluate-m1-half-tilt"].needs == ("streams-half", "record-m1-half")
    assert jobs["evaluate-m1-half-d2"].needs[-1] == "evaluate-m1-half-d1" and jobs["evaluate-m1-half-d1"].needs[-1] == "evaluate-m1-base-solo"
    # without sources one result serves all that is derived of a stream
    assert [n for n in jobs if n.endswith("solo")] == ["evaluate-m1-base-solo"]
    assert set(jobs["table"].needs) == {n for n in jobs if n.startswith(("evaluate", "vote"))}


def test_own_answers_and_their_streams():
    p = plan(own_answer=True, steps=["own", "features", "record", "evaluate", "combination"], eval_conditions=["tilt", "solo"])
    jobs = {j.name: j for j in p.jobs(lambda w: None)}
    assert jobs["own-m1-half"].needs == ("own-m1-base-solo",) and jobs["features-m1-half"].needs == ("own-m1-half",)
    assert jobs["combination-m1-half"].needs == ("record-m1-half", "evaluate-m1-half-tilt", "own-m1-base-solo")
    with pytest.raises(ValueError, match="own"):
        plan(own_answer=True, record={"fit": "base"})
    with pytest.raises(ValueError, match="own_answer"):
        plan(steps=["combination"]).work()
    with pytest.raises(KeyError, match="not defined"):
        plan(eval_conditions=["none"]).work()


def test_paths_views_and_peers():
    layout = Layout("/r", Registry(ENTITIES), CONDITIONS, own_answer=True)
    assert layout.record("m", "s", {"dim": 256}) == "/r/record/m/s+own/shuffled0.fit-self"
    assert layout.record("m", "s", {"dim": 8, "precision": 2.0, "order": "fixed"}).endswith("/fixed.fit-self.dim-8.precision-2")
    assert layout.evaluation("m", "half", "solo") == "/r/evaluation/m/base/solo" and layout.evaluation("m", "half", "tilt") == "/r/evaluation/m/half+own/tilt"
    assert [(p["tag"], p["engine"], p["index"]) for p in layout.peers("half")] == [("p0", "x", 0), ("p1", "y", 1)]
    assert layout.view("base", {"tool": "search"}) == {"stream": "base_search", "context": False} and layout.view("base", {})["context"]
    smoke = plan(smoke={"events": 5}, smoke_run=True)
    assert smoke.limit == 5 and smoke.datasets == ["base"] and smoke.layout.stream("base") == "/data/x/smoke/streams/base"


def test_a_runner_makes_what_is_not_there(spark, tmp_path):
    p = plan()
    p.layout = Layout(str(tmp_path), p.layout.registry, CONDITIONS)
    made = []

    def write(spark, work):
        made.append(work.name)
        spark.range(1).write.parquet(work.makes)

    runner = Runner(spark, dict.fromkeys(("streams", "features", "record"), write))
    with pytest.raises(RuntimeError, match="nothing runs"):
        runner.run(p, ["peers"], retries=0)
    assert set(runner.run(p, ["streams", "features", "record"]).values()) == {"ran"} and len(made) == 8
    assert set(runner.run(p, ["streams", "features", "record"]).values()) == {"kept"} and len(made) == 8
    assert p.view(spark, ["record"]).count() == 3


def test_jobs_of_a_wave_run_together():
    both = threading.Barrier(2, timeout=20)
    jobs = [Job("a", (), both.wait), Job("b", (), both.wait), Job("c", ("a", "b"), lambda: None)]
    assert execute(jobs) == dict.fromkeys("abc", "ran")
    tries = []
    with pytest.raises(ZeroDivisionError):
        execute([Job("x", (), lambda: tries.append(1) or 1 / 0), Job("y", ("x",), lambda: tries.append(2))])
    assert tries == [1, 1]


def test_settings_by_paths(tmp_path):
    deep = {"a": {"b": 1, "c": {}}, "d": [1]}
    assert leaves(deep) == {("a", "b"): 1, ("a", "c"): {}, ("d",): [1]} and nested(leaves(deep)) == deep
    assert over({"a": {"b": 1, "c": 2}, "d": {"e": 3}}, {"a": {"c": 4}, "d": 5}) == {"a": {"b": 1, "c": 4}, "d": 5}
    assert over({"a": 1}, {"a": {"b": 2}}) == {"a": {"b": 2}} and over({"a": {"b": 2}}, {}) == {"a": {"b": 2}}
    (tmp_path / "base.json").write_text('{"x": {"y": 1, "z": 2}, "n": 3}')
    (tmp_path / "top.json").write_text('{"base": "base.json", "x": {"z": 5}}')
    assert load_config(tmp_path / "top.json", {"x.w": 7, "q.r": 8}) == {"x": {"y": 1, "z": 5, "w": 7}, "n": 3, "q": {"r": 8}}
    with pytest.raises(ValueError, match="not a group"):
        load_config(tmp_path / "top.json", {"n.m": 1})
    (tmp_path / "loop.json").write_text('{"base": "loop.json"}')
    with pytest.raises(ValueError, match="own base"):
        load_config(tmp_path / "loop.json")
    assert registry.stale({"a": 1}, {"a": 1, "b": 2}) == ""
