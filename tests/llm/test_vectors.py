"""The permutation index against brute force, vector codes against a plain version."""

import hashlib
import math
import os
import random

import numpy as np
import pytest

from veritally.llm import permutation_index, vector_codes

FOLDER = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, label int, score double, code string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 0.5, "c", 1) for i, v, label in rows], SCHEMA)


def singles(rows):
    """Vectors as the float column holds them."""
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def usable(rows, zeros):
    found = [(i, tuple(v), label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    return [r for r in found if zeros or any(r[1])]


def nearest(rows, query, k=10):
    """(vec_id, distance) of the k nearest other rows, rows equal in key and vector taken once."""
    others = {(i, v) for i, v, _ in rows if (i, v) != query[:2]}
    return sorted((math.dist(v, query[1]), i) for i, v in others)[:k]


def clustered(rng, n, dim, hot):
    """A third of the rows is one vector, a third near copies of another, the rest by chance."""
    centre = rng.standard_normal(dim)
    rows = []
    for i in range(n):
        v = hot if i % 3 == 0 else centre + 0.05 * rng.standard_normal(dim) if i % 3 == 1 else rng.standard_normal(dim)
        rows.append((i, [float(np.float32(x)) for x in v], i % 4))
    return rows


@pytest.mark.parametrize("shard_rows", [300, 8192])
def test_a_small_table_is_searched_wholly(spark, shard_rows):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 900, 12, rng.standard_normal(12))
    df = frame(spark, rows)
    index = permutation_index.build(df, pivots=40, places=20, shard_rows=shard_rows)
    got = permutation_index.search(index, df.filter("vec_id % 100 = 0")).collect()
    plain = usable(rows, False)
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(by_query) == list(range(0, 900, 100))
    for i, found in by_query.items():
        want = nearest(plain, plain[i])
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and [v for _, v, _ in found] == [v for _, v in want]
        assert all(abs(s - d) < 1e-9 for (_, _, s), (d, _) in zip(found, want, strict=True))


def test_recall_with_hot_copies_and_near_copies(spark):
    """Few candidates of each shard, by footrule alone: 6 of 100 rows."""
    rng = np.random.default_rng(4)
    rows = clustered(rng, 6000, 32, rng.standard_normal(32))
    df = frame(spark, rows)
    index = permutation_index.build(df, pivots=256, places=64, candidates=120, shard_rows=2000)
    got = permutation_index.search(index, df.filter("vec_id % 100 = 0")).collect()
    points = np.array([v for _, v, _ in rows])
    found = {}
    for r in got:
        assert abs(r.score - np.linalg.norm(points[r.query_id] - points[r.vec_id])) < 1e-9
        found.setdefault(r.query_id, []).append(r.score)
    assert len(found) == 60 and all(len(x) == 10 for x in found.values())
    right = 0
    for i, scores in found.items():
        far = np.linalg.norm(points - points[i], axis=1)
        far[i] = np.inf
        right += sum(s <= np.partition(far, 9)[9] + 1e-9 for s in scores)
    assert right >= 0.9 * 600


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_whole_query_against_brute_force(spark):
    got = permutation_index.query(spark, FOLDER).collect()
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").toPandas()
    points, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy()
    queries = [i for i in ids if i % 100 == 0]
    assert sorted({(r.query_id, r.rank) for r in got}) == [(i, k) for i in queries for k in range(1, 11)]
    right = 0
    for r in got:
        far = np.linalg.norm(points - points[ids == r.query_id][0], axis=1)
        assert r.vec_id != r.query_id and abs(far[ids == r.vec_id][0] - r.score) < 1e-9
        far[ids == r.query_id] = np.inf
        right += r.score <= np.partition(far, 9)[9] + 1e-9
    assert right >= 0.98 * len(got)


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = frame(spark, clustered(rng, 600, 8, rng.standard_normal(8)))
    index = permutation_index.build(df, pivots=20, places=10, shard_rows=200)
    whole = sorted(map(tuple, permutation_index.search(index, df.filter("vec_id % 50 = 0")).collect()))
    monkeypatch.setattr(permutation_index, "BLOCK_ROWS", 3)
    assert sorted(map(tuple, permutation_index.search(index, df.filter("vec_id % 50 = 0")).collect())) == whole


ODD = singles([
    (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [3.0, 4.0], None), (100, None, 1), (200, [0.0, 0.0], None), (300, [1.0, None], 2), (400, [float("nan"), 1.0], 2), (500, [float("inf"), 1.0], 2),
    (600, [], 2), (700, [1.0], 2), (None, [5.0, 5.0], 3), (800, [-0.0, 2.0], 3), (801, [0.0, 2.0], None), (900, [1.0, 2.0], 3), (901, [9.0, -9.0], 1),
])


def test_search_of_odd_tables(spark):
    df = frame(spark, ODD)
    got = permutation_index.search(permutation_index.build(df, pivots=4, places=2), df.filter("vec_id % 100 = 0")).collect()
    plain = [r for r in usable(ODD, False) if r[0] is not None and len(r[1]) == 2]
    want = []
    for q in {r[:2] for r in plain if r[0] % 100 == 0}:
        want += [(q[0], k, i, round(d, 9)) for k, (d, i) in enumerate(nearest(plain, q), 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted(want)
    for none in (df.limit(0), df.filter("vec_id = 100"), df.filter("vec_id = 901")):
        assert permutation_index.search(permutation_index.build(none), none).count() == 0
    with pytest.raises(ValueError, match="fewer"):
        permutation_index.search(permutation_index.build(df, k=3), df, k=10)


def brute_codes(rows, parts, entries, rounds):
    """Codes and errors by row, and the books, by plain loops."""
    found = usable(rows, True)
    lengths = [len(v) for _, v, _ in found]
    length = min(set(lengths), key=lambda n: (-lengths.count(n), n))
    data = [(i, label, [math.floor(256 * x) for x in v] + [0] * (-length % parts)) for i, v, label in found if len(v) == length]
    data.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(data[0][2]) // parts
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for _, _, x in data]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, codes, strict=True) if code[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    codes = assign()
    out = [(i, label, "".join(f"{e:02x}" for e in code), sum(far(c[p], books[p][code[p]]) for p in range(parts))) for (i, label, _), c, code in zip(data, cut, codes, strict=True)]
    return out, books


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 8, 2), (3, 64, 1), (16, 5, 3)])
def test_codes_equal_a_plain_version(spark, parts, entries, rounds):
    rng = np.random.default_rng(7)
    rows = clustered(rng, 200, 8, rng.standard_normal(8))
    random.Random(1).shuffle(rows)
    codes, books = vector_codes.compress(frame(spark, rows).repartition(3), parts=parts, entries=entries, rounds=rounds)
    want, plain = brute_codes(rows, parts, entries, rounds)
    assert books.tolist() == plain and order(map(tuple, codes.collect())) == order(want)


def test_codes_of_odd_tables(spark, tmp_path):
    want, plain = brute_codes(ODD, 16, 64, 2)
    path = str(tmp_path / "embeddings.parquet")
    frame(spark, ODD).write.parquet(path)
    got = vector_codes.query(spark, str(tmp_path)).collect()
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in plain for entry in book for x in entry).encode()).hexdigest()
    assert order(map(tuple, got)) == order((i, code, error, sums[label], digest) for i, label, code, error in want)
    assert vector_codes.compress(frame(spark, []))[0].count() == 0
    far = [(0, [1e30, -1e30], 1), (1, [0.5, 0.25], 1)]
    assert vector_codes.compress(frame(spark, far), parts=2, entries=1)[0].count() == 2


def test_products_are_exact_at_the_limit():
    most = math.isqrt((1 << 57) // 64)
    values = np.array([[most, -most] * 32, [-most, most] * 32, [most - 1, 1 - most] * 32], np.int64)
    books = values[:2].reshape(2, 16, 4).transpose(1, 0, 2).copy()
    codes, far = vector_codes.assigned(values, books)
    assert codes.tolist() == [[0] * 16, [1] * 16, [0] * 16] and far.sum(1).tolist() == [0, 0, 64]
