"""Vector code compression: product codes of integer vectors with exact integer codebooks.

A component x counts as floor(scale * x). A vector is cut into `parts` equal consecutive parts, and each part position has a codebook of `entries`
entries that starts as that part of the vectors of the least keys. A round assigns every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and replaces an entry by the floor of the mean of its parts; entries without parts stay. After the
rounds the parts are assigned once more, which gives the codes.

The codebooks (entries * length whole numbers) are broadcast. Tasks compute all distances of an Arrow batch by the norm expansion
|x|^2 - 2 x.b + |b|^2 with int64 matrix products, which are exact, and take the first least one. Each task adds up its own sums by entry, a shuffle
grouped by part and entry merges them, and the new codebooks come to the driver: entries * length numbers, however many rows there are. All sums are of
whole numbers, so results do not depend on how rows are dealt to tasks.

Defined results: rows with a null or empty vector, or with null or non-finite components, are dropped, and so are vectors whose length is not the commonest one (of several the
least). A length that `parts` does not divide is filled up with zeros. With fewer rows than entries the codebooks have as many entries as there
are rows. Rows with a null key take part; they come last among the least keys. Ties of keys go by the components; repeated rows are rows. Null labels are one label. So that
products stay exact, whole components are limited to the root of 2 ** 57 / length: for 64 components values beyond +-185,363 count as that.
Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, table
from .vectors import commonest_length, finite, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


def assigned(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and the squared distance to it, of each part (columns) of each row; books is part, entry, position."""
    parts, _, width = books.shape
    codes, far = np.empty((2, len(values), parts), np.int64)
    for p in range(parts):
        x = values[:, p * width : (p + 1) * width]
        away = (x * x).sum(1)[:, None] - 2 * (x @ books[p].T) + (books[p] * books[p]).sum(1)
        codes[:, p] = away.argmin(1)
        far[:, p] = away[np.arange(len(x)), codes[:, p]]
    return codes, far


def whole(vectors: DataFrame, key: str, vector: str, label: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """_id, _label and _x (whole components, filled up) of the rows that take part, stored, and the length."""
    rows = finite(vectors.select(F.col(key).alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("_given")), "_given")
    length = commonest_length(rows)
    most, fill = math.isqrt((1 << 57) // max(1, length)), -length % parts
    x = F.transform("_v", lambda c: F.floor(F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), c * scale))).cast("long"))
    x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), fill)) if fill else x
    return table(rows.filter(F.size("_v") == length).select("_id", "_label", x.alias("_x")), "code-vectors"), length + fill


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape

    def sums(batches):
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            values = matrix(batch.column("_x"), np.int64)
            codes, _ = assigned(values, books)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], values[:, p * width : (p + 1) * width])
                count[p] += np.bincount(codes[:, p], minlength=entries)
        used = np.argwhere(count)
        if len(used):
            at = tuple(used.T)
            lists = pa.ListArray.from_arrays(np.arange(0, len(used) * width + 1, width, dtype=np.int32), total[at].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(used[:, 0]), pa.array(used[:, 1]), pa.array(count[at]), lists], ["part", "entry", "n", "sums"])

    each = rows.select("_x").mapInArrow(sums, "part long, entry long, n long, sums array<bigint>")
    merged = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
    books = books.copy()
    for r in merged.collect():
        books[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return books


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error of every row that takes part, stored; codebooks as part, entry, position)."""
    rows, length = whole(vectors, key, vector, label, parts, scale)
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "_x").limit(entries).select("_x").toArrow()
    books = matrix(first["_x"], np.int64) if len(first) else np.zeros((0, length), np.int64)
    books = np.ascontiguousarray(books.reshape(len(first), parts, length // parts).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        books = improved(rows, books)

    def coded(batches):
        for batch in batches:
            codes, far = assigned(matrix(batch.column("_x"), np.int64), books)
            text = codes.astype(np.uint8).tobytes().hex()
            code = pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), code, pa.array(far.sum(1))], ["_id", "_label", "code", "error"])

    kinds = dict(rows.dtypes)
    out = table(rows.mapInArrow(coded, f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long"), "codes")
    forget(rows)
    return out.select(F.col("_id").alias(key), F.col("_label").alias(label), "code", "error"), books


def digest(books: np.ndarray) -> str:
    """sha256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = codes.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    assign = """c{k} AS (SELECT vec_id, row, label, m, CAST(near.i AS BIGINT) AS e, near.d AS d, x FROM (
  SELECT p.*, (SELECT min(struct_pack(d := list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), i := b.e)) FROM b{k} b WHERE b.m = p.m) AS near FROM p))"""
    update = """b{n} AS (SELECT b.m, b.e, CASE WHEN s.x IS NULL THEN b.x ELSE s.x END AS x FROM b{k} b LEFT JOIN (
  SELECT m, e, list(v ORDER BY j) AS x FROM (SELECT m, e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS v FROM c{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS j) GROUP BY m, e, j) GROUP BY m, e) s ON s.m = b.m AND s.e = b.e)"""
    steps = []
    for k in range(rounds + 1):
        steps.append(assign.format(k=k))
        if k < rounds:
            steps.append(update.format(k=k, n=k + 1))
    return f"""WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS row, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT vec_id, label, row, m, x[CAST(m * len(x) // {PARTS} + 1 AS BIGINT) : CAST((m + 1) * len(x) // {PARTS} AS BIGINT)] AS x FROM v, (SELECT unnest(range({PARTS})) AS m)),
b0 AS (SELECT m, row - 1 AS e, x FROM p WHERE row <= {ENTRIES}),
{', '.join(steps)},
codes AS (SELECT vec_id, row, any_value(label) AS label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY m) AS code, CAST(sum(d) AS BIGINT) AS error FROM c{rounds} GROUP BY vec_id, row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  sha256((SELECT string_agg(array_to_string(x, ','), ',' ORDER BY m, e) FROM b{rounds})) AS codebooks_sha256 FROM codes"""


SQL = _sql()
