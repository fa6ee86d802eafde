"""A stream in parallel blocks equals the walk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.operators import blocked, record


@pytest.mark.parametrize("keep", [1.0, 0.93])
@pytest.mark.parametrize("block", [1, 7, 50, 100_000])
@pytest.mark.parametrize("write", [None, "w"])
def test_blocks_equal_the_walk(spark, keep, block, write):
    rng = np.random.default_rng(int(block + 10 * keep))
    rows = [("a" if k % 3 else "b", 2 * k, rng.standard_normal(3).tolist(), rng.integers(0, 2, 2).tolist(), k % 4 != 1) for k in range(150)]
    df = spark.createDataFrame(rows, "s string, pos long, address array<double>, labels array<int>, w boolean").repartition(5)
    args = {"key": "s", "pos": "pos", "write": write, "precision": 10.0, "keep": keep}
    want = {(r.s, r.pos): r for r in record.fold(df, **args).collect()}
    got = {(r.s, r.pos): r for r in blocked.fold_in_blocks(df, **args, block=block).collect()}
    assert set(got) == set(want) and len(got) == 150
    for k, r in want.items():
        assert np.allclose(got[k].mean, r.mean, atol=1e-9) and np.isclose(got[k].variance, r.variance) and np.allclose(got[k].probability, r.probability) and np.isclose(got[k].evidence, r.evidence)


def test_an_empty_stream(spark):
    none = spark.createDataFrame([], "s string, pos long, address array<double>, labels array<int>")
    assert blocked.fold_in_blocks(none, "s", "pos").count() == 0


def test_a_null_key_and_floats(spark):
    df = spark.range(40).select(F.lit(None).cast("string").alias("s"), F.col("id").alias("pos"), F.array((F.col("id") % 5).cast("float")).alias("address"), F.array((F.col("id") % 2).cast("int")).alias("labels"))
    got = {r.pos: r for r in blocked.fold_in_blocks(df, "s", "pos", block=9).collect()}
    want = {r.pos: r for r in record.fold(df, "s", "pos").collect()}
    assert all(np.allclose(got[p].mean, r.mean) for p, r in want.items()) and len(got) == 40
