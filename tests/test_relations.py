"""As-of and interval joins against plain loops; the numerics of a record."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.operators import numerics
from veritally.operators.asof import as_of
from veritally.operators.intervals import held_values, interval_join, level
from veritally.operators.joins import token_values
from veritally.operators.record import Posterior

# ---------------------------------------------------------------- as of


def sides(seed, n=400):
    """Half of the rows under one key, many places told and asked more than once, null keys and places."""
    rng = random.Random(seed)
    key = lambda: None if rng.random() < 0.03 else "hot" if rng.random() < 0.5 else f"k{rng.randrange(8)}"
    place = lambda: None if rng.random() < 0.03 else rng.randrange(120)
    return [(k, key(), place()) for k in range(n)], [(k, key(), place(), rng.choice([None, k % 5])) for k in range(n // 2)]


def plain_as_of(left, right, strict):
    out = {}
    for i, k, t in left:
        found = [(u, j, v) for j, m, u, v in right if m is not None and m == k and u is not None and t is not None and (u < t or (u == t and not strict))]
        out[i] = max(found)[1:] if found else (None, None)
    return out


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("block_rows", [9, 60, 100_000])
def test_as_of_in_blocks_equals_a_plain_version(spark, strict, block_rows):
    left, right = sides(block_rows)
    a = spark.createDataFrame(left, "i int, k string, t int")
    b = spark.createDataFrame(right, "j int, k string, u int, v int")
    out = as_of(a, b, ["k"], "t", ["j", "v"], right_at="u", last=["j"], strict=strict, block_rows=block_rows)
    assert out.columns == ["i", "k", "t", "j", "v"]
    want = plain_as_of(left, right, strict)
    got = {r.i: (r.j, r.v) for r in out.collect()}
    assert got == want and len(got) == out.count() == len(left)
    inner = as_of(a, b, ["k"], "t", ["j"], right_at="u", last=["j"], strict=strict, how="inner", block_rows=block_rows).collect()
    assert {r.i: r.j for r in inner} == {i: j for i, (j, _) in want.items() if j is not None}


def test_as_of_times_several_keys_and_empty_sides(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    a = spark.createDataFrame([(1, "x", 1, at(3)), (2, "x", 1, at(1)), (3, "x", 2, at(9)), (4, "y", 1, at(3))], "i int, k string, l int, t timestamp")
    b = spark.createDataFrame([("x", 1, at(2), "two"), ("x", 1, at(3), "three"), ("x", 2, at(10), "late"), ("y", 2, at(1), "other")], "k string, l int, t timestamp, s string")
    got = {r.i: r.s for r in as_of(a, b, ["k", "l"], "t", ["s"]).collect()}
    assert got == {1: "three", 2: None, 3: None, 4: None}
    day = lambda df: df.withColumn("t", F.to_date("t"))
    assert {r.i: r.s for r in as_of(day(a), day(b), ["k", "l"], "t", ["s"], strict=True).collect()} == dict.fromkeys(range(1, 5))
    assert {r.i: r.s for r in as_of(a, b.limit(0), ["k", "l"], "t", ["s"]).collect()} == dict.fromkeys(range(1, 5))
    assert as_of(a.limit(0), b, ["k", "l"], "t", ["s"]).count() == 0


def test_one_key_is_many_blocks(spark):
    """The windows of a key that has all rows see a block of them at a time."""
    a = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    b = spark.range(0, 5000, 1700).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.col("id").alias("s"))
    out = as_of(a, b, ["k"], "t", ["s"], block_rows=500)
    assert out.filter(F.col("s") != F.floor(F.col("t") / 1700) * 1700).count() == 0 and out.count() == 5000


# ---------------------------------------------------------------- intervals


def test_levels_are_the_least_that_hold_a_length(spark):
    lengths = [1, 15, 16, 17, 31, 32, 33, 64, 65, 1 << 40, (1 << 40) + 1, 16 << 45]
    got = [r.l for r in spark.createDataFrame([(n,) for n in lengths], "n long").select("n", level(F.col("n"), 16).alias("l")).orderBy("n").collect()]
    assert got == [next(k for k in range(64) if n <= 16 << k) for n in lengths]


@pytest.mark.parametrize("kind", ["within", "overlaps"])
@pytest.mark.parametrize("width", [1, 16, 1000])
def test_intervals_equal_a_plain_version(spark, kind, width):
    rng = random.Random(width)
    key = lambda: None if rng.random() < 0.05 else "hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}"

    def span(long):
        a = rng.randrange(-500, 3000)
        return a, a + rng.choice([0, -3, 1, 7, 40, *([2500] if long else [])])

    left = [(k, key(), *span(rng.random() < 0.05)) for k in range(150)] + [(900, "hot", None, 3), (901, "hot", 3, None)]
    right = [(k, key(), *span(rng.random() < 0.2)) for k in range(150)] + [(900, "hot", None, 3), (901, "hot", 3, None)]
    out = interval_join(spark.createDataFrame(left, "i int, k string, a long, b long"), spark.createDataFrame(right, "j int, k string, c long, d long"), ["k"], ("a", "b"), ("c", "d"), kind, width)
    got = sorted((r.i, r.j) for r in out.collect())
    want = []
    for i, k, a, b in left:
        for j, m, c, d in right:
            if k is not None and k == m and None not in (a, b, c, d) and b > a and d > c and ((a >= c and b <= d) if kind == "within" else (a < d and c < b)):
                want.append((i, j))
    assert got == sorted(want) and out.columns == ["k", "i", "a", "b", "j", "c", "d"]


def test_values_by_bins_are_those_of_the_lists(spark):
    rng = random.Random(3)
    tokens = [(f"e{rng.randrange(3)}", k, a, a + rng.choice([0, 1, 5])) for k in range(200) for a in [rng.randrange(400)]]
    spans = [(f"e{rng.randrange(3)}", k, a, a + rng.choice([0, 20, 300]), float(rng.randrange(4))) for k in range(30) for a in [rng.randrange(400)]]
    t = spark.createDataFrame(tokens, "id string, token int, start long, end long")
    s = spark.createDataFrame(spans, "id string, span int, start long, end long, value double")
    key = lambda df: sorted(map(tuple, df.select("id", "token", "start", "end", "value").collect()))
    assert key(held_values(t, s)) == key(token_values(t, s))
    assert key(held_values(t, s.limit(0))) == [(*r, 0.0) for r in sorted(tokens)]


# ---------------------------------------------------------------- numerics


def addresses(n, dim, seed=0):
    """A few directions carry most of the variance."""
    rng = np.random.default_rng(seed)
    strong = rng.standard_normal((dim, 3))
    return (rng.standard_normal((n, 3)) * 3) @ strong.T + 0.3 * rng.standard_normal((n, dim)), rng.integers(0, 2, n)


def test_all_paths_hold_the_same_covariance():
    x, labels = addresses(3000, 20)
    study, record = numerics.Study(20, 10.0), Posterior(20, 1, 10.0)
    for row, label in zip(x, labels, strict=True):
        study.write(row, 2.0 * label - 1)
        record.write(row, [2.0 * label - 1])
    for r in study.report():
        assert r["covariance_drift"] < 1e-9 and r["mean_drift"] < 1e-8 and r["least_eigenvalue"] > 0 and r["asymmetry"] < 1e-10
        assert np.allclose(study.paths[r["path"]].covariance(), record.matrix, rtol=1e-6)
    root = next(r for r in study.report() if r["path"] == "root")
    assert root["asymmetry"] < 1e-15


def test_the_root_stays_definite_where_the_short_form_fails():
    """Addresses a billion times as long as the spread of the rest: the short form's covariance loses its least eigenvalues."""
    rng = np.random.default_rng(1)
    study = numerics.Study(6, 1e-8)
    for _ in range(400):
        study.write(rng.standard_normal(6) * np.array([1e5, 1e5, 1, 1, 1e-3, 1e-3]), 1.0)
    found = {r["path"]: r for r in study.report()}
    assert found["root"]["least_eigenvalue"] > 0 and found["root"]["covariance_drift"] < 1e-6 < found["short"]["covariance_drift"]


def test_report_at_checkpoints_of_each_stream(spark):
    x, labels = addresses(70, 4)
    rows = [("a" if k % 3 else None, k, row.tolist(), int(y)) for k, (row, y) in enumerate(zip(x, labels, strict=True))]
    got = numerics.covariance_report(spark.createDataFrame(rows, "stream string, pos int, address array<double>, label int"), "stream", "pos", every=20).collect()
    assert sorted({(r.stream or "", r.writes) for r in got}) == [("", 20), ("", 24), ("a", 20), ("a", 40), ("a", 46)] and {r.path for r in got} == set(numerics.PATHS)
    study = numerics.Study(4, 100.0)
    for s, _, row, y in rows:
        if s == "a" and study.writes < 40:
            study.write(np.array(row), 2.0 * y - 1)
    want = {r["path"]: r for r in study.report()}
    assert all(abs(r.trace - want[r.path]["trace"]) < 1e-12 for r in got if r.stream == "a" and r.writes == 40)
