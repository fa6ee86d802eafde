"""Tasks from files."""

import json

import pytest

from veritally.functions import tasks
from veritally.plans import task_files


@pytest.fixture
def known():
    before = dict(tasks.REGISTRY)
    yield
    tasks.REGISTRY.clear()
    tasks.REGISTRY.update(before)


def write(folder, **files):
    for name, content in files.items():
        (folder / f"{name}.json").write_text(json.dumps(content))


def test_a_task_over_an_existing_rule_is_a_file(spark, tmp_path, known):
    write(tmp_path, Exam={"grader": "mcqa", "max_tokens": 64}, judged={"grader": "rag", "precomputed": True}, _template={"grader": "none"})
    configs = task_files.register(tmp_path)
    assert sorted(configs) == ["exam", "judged"] and configs["exam"]["max_tokens"] == 64 and task_files.settings(configs, "EXAM")["grader"] == "mcqa"
    rows = [(1, "exam", "(B)", "Final answer: b", None), (2, "exam", "A", "Final answer: b", None), (3, "boolqa", "yes", "yes", None), (4, "nothing", "x", "x", None)]
    df = spark.createDataFrame([(*r, ["x", "y"]) for r in rows], "id int, task_type string, answer string, text string, stored double, choices array<string>")
    assert {r.id: r.correct for r in tasks.graded(df, "text", "stored").collect()} == {1: 1, 2: 0, 3: 1, 4: 0}
    assert {r.id: r.key for r in tasks.agreement_keys(df, "text").collect()} == {1: "b", 2: "b", 3: "yes", 4: None}
    assert tasks.get("judged").precomputed and not tasks.get("exam").precomputed


def test_faults(tmp_path, known):
    write(tmp_path, one={"grader": "mcqa"})
    configs = task_files.load(tmp_path)
    with pytest.raises(KeyError, match="there are one"):
        task_files.settings(configs, None)
    write(tmp_path, two={"grader": "guess"}, three={})
    with pytest.raises(KeyError, match=r"three \(None\), two \(guess\); there are boolqa"):
        task_files.load(tmp_path)
    (tmp_path / "two.json").unlink()
    (tmp_path / "three.json").unlink()
    write(tmp_path, ONE={"grader": "rag"})
    with pytest.raises(ValueError, match="are one task"):
        task_files.load(tmp_path)
    assert task_files.load(tmp_path / "nowhere") == {}
