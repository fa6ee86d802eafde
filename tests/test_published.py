"""Versions and the pointer under crashes; answers by source resumed."""

import os

import pytest
from pyspark.sql import functions as F

from veritally.sources import published as P


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("crash", ["write", "pointer", "rename", None])
def test_a_crash_leaves_the_old_result_or_the_new_one(spark, tmp_path, monkeypatch, crash):
    path = str(tmp_path / "r")
    assert P.published(spark, path) is None and P.about(spark, path) is None and P.sweep(spark, path) == []
    first = P.publish_version(spark.range(3), path, note="old")
    reader = P.published(spark, path)

    def fail(*_, **__):
        raise RuntimeError("crash")

    new = spark.range(5)
    if crash == "write":
        new = new.select(F.when(F.col("id") == 4, F.raise_error(F.lit("crash"))).otherwise(F.col("id")).alias("id"))
    if crash == "pointer":
        monkeypatch.setattr(P, "replace", fail)
    if crash == "rename":
        monkeypatch.setattr(P, "_move_over", fail)
    if crash:
        with pytest.raises(Exception, match="crash"):
            P.publish_version(new, path, note="new")
    else:
        P.publish_version(new, path, note="new")
    monkeypatch.undo()
    assert ids(P.published(spark, path)) == list(range(3 if crash else 5)) and P.about(spark, path)["note"] == ("old" if crash else "new")
    assert ids(reader) == [0, 1, 2]  # who had begun to read keeps its version
    gone = P.sweep(spark, path)
    assert len(gone) <= 1 and (first in gone) == (crash is None) and len(os.listdir(tmp_path / "r" / "versions")) == 1
    P.publish_version(spark.range(7), path)
    assert ids(P.published(spark, path)) == list(range(7))


def answers(spark, sources, n=20, word="first"):
    rows = [(f"e{k}", s, f"{word} {k}") for s in sources for k in range(n)]
    return spark.createDataFrame(rows, "id string, source string, response string")


def test_only_incomplete_sources_are_written_again(spark, tmp_path):
    path = str(tmp_path)
    expected = spark.createDataFrame([("a", 20), ("b", 20), ("07", 20), ("d", 20)], "source string, rows long")
    assert P.answers_by_source(spark, path).count() == 0
    cut = answers(spark, ["a", "b", "07"]).filter("source <> 'b' OR id < 'e15'")
    got = {r.source: (r.rows, r.expected) for r in P.unpack_by_source(cut, path, expected).collect()}
    assert got["a"] == got["07"] == (20, 20) and got["b"][0] < 20 and got["d"] == (0, 20)
    assert {r.source for r in P.answers_by_source(spark, path).select("source").distinct().collect()} == {"a", "07"}
    files = {s: sorted(os.listdir(tmp_path / "answers" / f"source={s}")) for s in ("a", "07")}
    again = P.unpack_by_source(answers(spark, ["a", "b", "07", "d"], word="second"), path, expected)
    assert sorted(r.source for r in again.collect()) == ["b", "d"]
    assert files == {s: sorted(os.listdir(tmp_path / "answers" / f"source={s}")) for s in ("a", "07")}
    words = {(r.source, r.response.split()[0]) for r in P.answers_by_source(spark, path).collect()}
    assert words == {("a", "first"), ("07", "first"), ("b", "second"), ("d", "second")} and P.answers_by_source(spark, path).count() == 80
    assert P.unpack_by_source(answers(spark, ["a"]), path, expected).count() == 0


def test_a_crash_before_the_list_is_published_is_mended_by_the_next_run(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    expected = spark.createDataFrame([("a", 20)], "source string, rows long")
    monkeypatch.setattr(P, "replace", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        P.unpack_by_source(answers(spark, ["a"]), path, expected)
    monkeypatch.undo()
    assert P.answers_by_source(spark, path).count() == 0
    P.unpack_by_source(answers(spark, ["a"], word="second"), path, expected)
    assert {r.response.split()[0] for r in P.answers_by_source(spark, path).collect()} == {"second"}
