import pytest

from veritally.functions import tasks

SCHEMA = "id long, task_type string, problem string, answer string, answer_aliases array<string>, choices array<string>, choice_labels array<string>, context array<string>, code_format string, text string, stored double"


def row(k, task, answer, text, stored=None, problem="", choices=None, context=None, form=None, aliases=None):
    return (k, task, problem, answer, aliases, choices, None, context, form, text, stored)


ROWS = [
    row(0, "math", "0.5", "so \\boxed{\\frac{1}{2}}"),
    row(1, None, "7", "I get 8"),
    row(2, "rag", "the Seine", "Answer: Seine River."),
    row(3, "RAG", "Rome", "Answer: near Paris", aliases=["paris"]),
    row(4, "boolqa", "yes", "<think>no</think> Final answer: TRUE"),
    row(5, "mcqa", "(B)", "Final answer: B", choices=["x", "y"]),
    row(6, "shortqa", "(A)", "Final answer: (a).", problem="Options: (A) x (B) y"),
    row(7, "subqa", "Oslo", "It is the city of Oslo in Norway"),
    row(8, "code", "", "```python\nprint(1)\n```", 1.0),
    row(9, "code", "", "print(1)"),
    row(10, "boolqa", "no", None),
    row(11, "rag", "x", "Answer: y", 0.5),
]


def test_grading_by_task(spark):
    out = {r.id: r for r in tasks.graded(spark.createDataFrame(ROWS, SCHEMA), "text", "stored").collect()}
    assert {k: r.correct for k, r in out.items()} == {0: 1, 1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0, 7: 1, 8: 1, 9: 0, 10: 0, 11: 1}
    assert out[2].target == pytest.approx(2 / 3)


def test_extraction_and_keys(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.id: r.extracted for r in tasks.extracted(df, "text").collect()}
    assert (got[0], got[2], got[5], got[8]) == ("1/2", "Seine River", "B", "print(1)")
    keys = {r.id: r.key for r in tasks.agreement_keys(df, "text").collect()}
    assert (keys[2], keys[4], keys[5], keys[6], keys[8], keys[10]) == ("seine river", "yes", "b", "option a", None, None)
    with pytest.raises(KeyError, match="no task"):
        tasks.get("chess")


def test_acceptance(spark):
    long = "because the river crosses several famous bridges within this beautiful capital during summer"
    rows = [
        row(0, "boolqa", "yes", "ok"),
        row(1, "boolqa", "yes", "<think>hm"),
        row(2, "boolqa", "yes", "Final answer: yes", 1.0),
        row(3, "boolqa", "yes", "I cannot help with that. Final answer: no"),
        row(4, "boolqa", "yes", "word " * 12 + "Final answer: no"),
        row(5, "rag", "Rome", "This is deliberately wrong. The correct answer is Rome.\nAnswer: Oslo", context=["Oslo and Rome"], problem="where"),
        row(6, "rag", "Rome", f"{long}\nAnswer: Berlin", context=[long]),
        row(7, "math", "4", "I think it is 12"),
        row(8, "code", "", "```python\ndef f(x):\n    y = x\n    return y\n```"),
        row(9, "code", "", "```python\nx = 1\ny = 2\nprint(x)\n```", form="io"),
        row(10, "boolqa", "yes", "The evidence points the other way. Final answer: no", 0.0, problem="evidence"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).fillna(0.0, ["stored"])
    got = {r.id: (r.reasons, r.soft, r.accepted) for r in tasks.acceptance(df, "text", "stored").collect()}
    assert [got[k][0] for k in range(11)] == [["empty"], ["unfinished"], ["still_correct"], ["refusal"], ["degenerate"], ["leak", "gold_leak"], ["ungrounded"], [], [], ["format"], []]
    assert got[6][1] == ["ungrounded"] and got[10][2]
    loose = {r.id: r.accepted for r in tasks.acceptance(df, "text", "stored", strict=False).collect()}
    assert loose[6] and not loose[2]


def test_wrong_labels_are_wrong_and_stay(spark):
    df = spark.createDataFrame([row(k, "mcqa", "B", "", choices=["x", "y", "z"]) for k in range(30)] + [row(30, "boolqa", "yes", ""), row(31, "math", "3", "")], SCHEMA)
    a, b = ({r.id: r.wrong for r in tasks.wrong_label(df, "id").collect()} for _ in range(2))
    assert a == b and {a[k] for k in range(30)} == {"A", "C"} and a[30] == "no" and a[31] == ""
