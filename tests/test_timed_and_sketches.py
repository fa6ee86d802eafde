"""Values under a time limit; distinct counts merged from shards."""

import os
import re
import time

from pyspark.sql import functions as F

from veritally.functions import timed
from veritally.operators import sketches


def hostile(text, n):
    if text == "die":
        os._exit(3)
    if text == "fail":
        raise KeyError(text)
    return bool(re.fullmatch(r"(a+)+b", text)) or len(text) == n


def test_a_hostile_value_times_out_and_its_neighbours_do_not(spark):
    rows = [(k, t, n) for k, (t, n) in enumerate([("aab", 0), ("xy", 2), ("a" * 40 + "c", 0), ("xyz", 2), ("die", 0), ("fail", 0), ("aaab", 9), ("a" * 45, 0), ("x", 1)])]
    df = spark.createDataFrame(rows, "k int, t string, n int").coalesce(1)
    began = time.time()
    got = {r.k: tuple(r.g) for r in df.select("k", timed.timed_udf(hostile, "boolean", 1.0)("t", "n").alias("g")).collect()}
    assert got == {0: (True, "graded"), 1: (True, "graded"), 2: (None, "timeout"), 3: (False, "graded"), 4: (None, "error: died"), 5: (None, "error: KeyError"), 6: (True, "graded"), 7: (None, "timeout"), 8: (True, "graded")}
    assert time.time() - began < 60


def test_children_end_with_their_owner():
    run = timed.Timed(hostile, 1.0)
    assert run("aab", 0) == (True, "graded")
    child = run.child
    assert child.is_alive()
    run.end()
    assert not child.is_alive() and run("x", 1) == (True, "graded")
    run.end()


def test_grading_within_a_limit(spark):
    df = spark.createDataFrame([(0, "\\boxed{2x+2}", "2(x+1)"), (1, "\\boxed{3}", "4"), (2, None, "4")], "k int, a string, b string")
    got = {r.k: tuple(r.g) for r in df.select("k", timed.answers_agree_within()("a", "b").alias("g")).collect()}
    assert got == {0: (True, "graded"), 1: (False, "graded"), 2: (False, "graded")}


def test_merged_sketches_equal_one_pass_within_the_error(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 10 < 9, F.pmod(F.col("id") * 7919, F.lit(20_011))).alias("v"), F.col("id"))
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
    one = {r.g: r.distinct for r in sketches.estimated(df.groupBy("g").agg(F.hll_sketch_agg("v", F.lit(sketches.LG)).alias("sketch"))).collect()}
    shards = sketches.shard_sketches(df, ["g"], F.col("id") % 7, "v")
    assert shards.count() == 21
    parts = [shards.filter(F.col("shard") < 3), shards.filter(F.col("shard") >= 3)]
    later = sketches.merged(parts[1], ["g"]).unionByName(sketches.merged(parts[0], ["g"]))  # sketches of sketches
    for found in (sketches.merged(shards, ["g"]), sketches.merged(later, ["g"])):
        got = {r.g: r.distinct for r in sketches.estimated(found).collect()}
        assert all(abs(got[g] - n) <= 4 * sketches.error() * n for g, n in exact.items())
        assert all(abs(got[g] - one[g]) <= 0.005 * n for g, n in exact.items())
    none = sketches.estimated(sketches.merged(sketches.shard_sketches(df.filter("v IS NULL"), ["g"], F.lit(0), "v"), ["g"]))
    assert {r.distinct for r in none.collect()} == {0}
