"""The manifest against a plain version."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from veritally.llm import merkle

from .data import SCHEMA, empty, odd, rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    values = [r.doc_id, r.source, r.lang, r.n_chars, text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """The last node, and the siblings and place of each leaf by level."""
    steps, nodes, over = [[] for _ in leaves], list(leaves), [[k] for k in range(len(leaves))]
    while len(nodes) > 1:
        ups, covers = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k in range(len(run)):
                for x in over[at + k]:
                    steps[x].append((run[:k], run[k + 1 :]))
            ups.append(h(*run))
            covers.append([x for k in range(len(run)) for x in over[at + k]])
        nodes, over = ups, covers
    return nodes[0], steps


def plain(data):
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    by_source = {}
    for r in data:
        by_source.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    done = {s: (sorted(by_source[s], key=lambda x: x[:3]),) for s in names}
    done = {s: (found, *tree([x[2] for x in found])) for s, (found,) in done.items()}
    if not names:
        return []
    root, above = tree([done[s][1] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        found, subroot, steps = done[s]
        for (_, _, digest, r), mine in zip(found, steps, strict=True):
            folded = leaf(r, r.text.translate(lower)) if r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else digest
            for left, right in mine + up:
                folded = h(*left, folded, *right)
            proof = h(*(x for left, right in mine + up for x in left + right))
            out.append((r.doc_id, digest, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def result(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return sorted(map(tuple, merkle.query(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"a": 700, "b": 17, "c": 16, "d": 1, None: 33, "": 2, "Ä": 257}, {f"s{k:03}": 1 for k in range(40)}, {"one": 300}, {"one": 1}])
def test_manifest_equals_a_plain_version(spark, tmp_path, sizes):
    rng = random.Random(2)
    data, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            data += rows([f"Text {n} with SOME capitals" if rng.random() < 0.7 else f"text {n}"], source=source, first=n)
            n += 1
    rng.shuffle(data)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = result(spark, df, tmp_path)
    assert got == plain(df.collect()) and len(got) == n
    assert any(not r[-1] for r in got) == any(r.text != r.text.lower() and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in df.collect())


def test_manifest_of_odd_tables(spark, tmp_path):
    df = odd(spark)
    assert result(spark, df, tmp_path / "odd") == plain(df.collect())
    assert result(spark, empty(spark), tmp_path / "none") == []
    same = spark.createDataFrame(rows(["Same Text"]) * 100, SCHEMA).repartition(3)
    assert result(spark, same, tmp_path / "same") == plain(same.collect())


def test_proofs_lead_from_the_leaf_to_the_root(spark):
    df = spark.createDataFrame(rows([f"text {k}" for k in range(50)]) + rows([f"other {k}" for k in range(3)], source="t", first=50), SCHEMA)
    out = merkle.manifest(df)
    assert out.filter(~F.col("verified")).count() == 0 and {r.n for r in out.select((F.length("proof") / 64).alias("n")).distinct().collect()} == {15 + 3 + 1, 1 + 3 + 1, 2 + 1}


@pytest.mark.parametrize("order", range(4))
def test_events_in_any_order_and_place_give_the_same_runs(spark, order):
    """Ranges, or rows of one tree in many tasks: what a task cannot resolve goes on by shuffle."""
    leaves = spark.range(1000).selectExpr("'t' AS _tree", "1000L AS _size", "id AS _at", "sha2(CAST(id AS string), 256) AS digest")
    dealt = [leaves.coalesce(1), leaves.repartition(7), leaves.orderBy(F.col("_at").desc()), leaves.repartition(4, F.col("_at") % 16)][order]
    got = {(r._level, r._at): r.digest for r in merkle.grown(dealt, "test").collect()}
    nodes, level, want = [h(str(k)) for k in range(1000)], 0, {}
    while len(nodes) > 1:
        nodes, level = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], level + 1
        want |= {(level, k): d for k, d in enumerate(nodes)}
    assert got == want
