"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots: of `pivots` vectors of the table it keeps the `places` nearest ones,
nearest first. Two vectors that see the pivots in a similar order are near each other; how similar the orders are is the
footrule distance, the sum over pivots of the difference of their places (a pivot that is not among the nearest ones stands at
place `places`). It equals places * (places + 1) - 2 * the sum over shared pivots of (places - the larger of both places), so it is
added up from the lists of the query's own pivots alone.

Index: vectors are dealt by hash to shards of at most about `shard_rows` rows (`SHARD_BYTES` bytes). A shard has its own inverted files:
for every pivot the rows that have it among their nearest, with its place. A shard is one row of a Parquet table, so the index
can be kept, and a lost executor costs a reread.

Search: queries are taken in blocks of bounded size, broadcast to the shards. In a shard a query adds up the lists of its pivots,
takes the `candidates` rows of least footrule distance (with all that tie with the last), and computes their exact Euclidean
distances. The best of all shards are merged. A shard gives each query its share of candidates, so the candidates grow
with the table and recall does not fall with it. No list is cut; the bound on candidates is the approximation, and recall is
measured against brute force in the tests. The work is queries times rows times places ** 2 / pivots list entries, whatever
the length of vectors.

Equal vectors are one entry of the index with the least `keep` of their keys, and equal queries are searched once. So a vector that
a third of the rows share costs as much as any other, and loses no result: of equal vectors no more than `keep` can be among the
nearest `keep - 1` others. Vectors are compared by two 64-bit hashes.

The pivots are chosen from a bounded sample of the distinct vectors (`SAMPLE` times `pivots` rows, those of least hash), each as the one farthest from
those before it: pivots drawn by chance fall into groups of near copies, see everything alike and waste places. Every row is indexed.

Defined results: rows with a null key, a null or empty vector, a zero vector, or null or non-finite components take no part; neither do vectors
whose length is not the commonest one (of several the least). Rows equal in key and vector are one row; one key with different vectors is several rows,
and a query of that key is answered once for each of its vectors. Ties go to the smaller key. With fewer than k other rows all are returned; a table
without usable rows gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BATCH, bounded_sample, forget, table
from .vectors import commonest_length, finite, matrix

PIVOTS, PLACES, CANDIDATES, SHARD_ROWS, SAMPLE = 512, 128, 512, 8192, 4
#: Vectors of a shard, and of a block of queries, in bytes at most; queries of a block at most.
SHARD_BYTES, BLOCK_BYTES, BLOCK_ROWS = 64_000_000, 32_000_000, 16_384

_INDEX = "shard long, vectors binary, starts binary, rows binary, places binary, ids array<array<bigint>>"
_FOUND = "_c string, id long, score double"


@dataclass
class Index:
    """`shards` is the stored table; pivots and settings are what a search needs beside it."""

    shards: DataFrame
    pivots: np.ndarray
    places: int
    candidates: int
    keep: int
    length: int


def spread(sample: np.ndarray, most: int) -> np.ndarray:
    """The first row, then always the row farthest from those chosen, ties to the first."""
    chosen, away = [], np.full(len(sample), np.inf)
    for _ in range(min(most, len(sample))):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first, ties to the lower number."""
    out = np.empty((len(vectors), places), np.int16)
    norms = (pivots * pivots).sum(1)
    for at in range(0, len(vectors), 2048):
        far = norms - 2 * (vectors[at : at + 2048] @ pivots.T)
        out[at : at + 2048] = np.argsort(far, axis=1, kind="stable")[:, :places]
    return out


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """_id, _v and _c, which is equal for equal vectors only."""
    df = finite(df.select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_given")), "_given", zeros=False).filter(F.col("_id").isNotNull())
    return df.select("_id", "_v", F.concat(F.hex(F.xxhash64("_v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "_v"))).alias("_c"))


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, pivots: int = PIVOTS, places: int = PLACES, candidates: int = CANDIDATES, shard_rows: int = SHARD_ROWS) -> Index:
    """An index that answers searches for up to k neighbours beside the query itself."""
    rows, keep = _rows(vectors, key, vector), k + 1
    length = commonest_length(rows)
    least = Window.partitionBy("_c").orderBy("_id")
    few = rows.filter(F.size("_v") == length).dropDuplicates(["_id", "_c"]).withColumn("_k", F.row_number().over(least)).filter(F.col("_k") <= keep)
    entries = table(few.groupBy("_c").agg(F.first("_v").alias("_v"), F.array_sort(F.collect_list("_id")).alias("_ids")), "vector-entries")
    sample = bounded_sample(entries.select("_c", "_v"), "_c", SAMPLE * pivots).toArrow()
    centres = spread(matrix(sample["_v"]), pivots) if len(sample) else np.zeros((0, length))
    places = min(places, len(centres))
    shards = max(1, math.ceil(entries.count() / max(1, min(shard_rows, SHARD_BYTES // (8 * max(1, length))))))

    def post(group: pa.Table) -> pa.Table:
        shard, points = group["_shard"][0].as_py(), matrix(group["_v"])
        near = nearest_pivots(points, centres, places)
        order = np.argsort(near.ravel(), kind="stable")  # by pivot, then by row
        starts = np.concatenate([[0], np.cumsum(np.bincount(near.ravel(), minlength=len(centres)))])
        data = [starts.astype(np.int64), (order // places).astype(np.int32), (order % places).astype(np.int32)]
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in [points, *data]]
        ids = group["_ids"].combine_chunks().cast(pa.list_(pa.int64()))
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.table([pa.array([shard], pa.int64()), *blobs, lists], ["shard", "vectors", "starts", "rows", "places", "ids"])

    dealt = entries.withColumn("_shard", F.pmod(F.xxhash64(F.lit(2), "_c"), F.lit(shards)))
    stored = table(dealt.groupBy("_shard").applyInArrow(post, _INDEX), "vector-index")
    forget(entries)
    return Index(stored, centres, places, candidates, keep, length)


def _best(points: np.ndarray, first: np.ndarray, ids: np.ndarray, chosen: np.ndarray, query: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The least distances and their ids, ties to the smaller id, of the chosen entries; entry e has ids[first[e] : first[e + 1]], ascending."""
    far = np.sqrt(((points[chosen] - query) ** 2).sum(1))
    if len(chosen) > keep:
        near = far <= np.partition(far, keep - 1)[keep - 1]
        chosen, far = chosen[near], far[near]
    count = first[chosen + 1] - first[chosen]
    at = np.repeat(first[chosen] - np.cumsum(count) + count, count) + np.arange(count.sum())
    far, found = np.repeat(far, count), ids[at]
    order = np.lexsort((found, far))[:keep]
    return far[order], found[order]


def search(index: Index, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query's vector, without the row of the query's own key and vector."""
    if k >= index.keep:
        raise ValueError("the index was built for fewer neighbours")
    spark = queries.sparkSession
    rows = _rows(queries, key, vector).filter(F.size("_v") == index.length)
    members = table(rows.select("_id", "_c").distinct(), "vector-queries")
    places, centres, candidates, keep = index.places, index.pivots, index.candidates, index.keep

    def ordered(batches):
        for batch in batches:
            near = nearest_pivots(matrix(batch.column("_v")), centres, places)
            lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, places, dtype=np.int32), near.ravel().astype(np.int32)) if places else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("_c"), batch.column("_v"), lists], ["_c", "_v", "_near"])

    asked = table(rows.dropDuplicates(["_c"]).select("_c", "_v").mapInArrow(ordered, "_c string, _v array<double>, _near array<int>"), "vector-asked")
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, index.length) + 4 * max(1, places))))
    blocks = math.ceil(asked.count() / size)
    best, found = Window.partitionBy("_c").orderBy("score", "id"), []
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64(F.lit(3), "_c"), F.lit(blocks)) == b).toArrow()
        if not len(block):
            continue
        sent = spark.sparkContext.broadcast((block["_c"].to_pylist(), matrix(block["_v"]), matrix(block["_near"], np.int32)))

        def looked_up(batches, sent=sent):
            names, points, near = sent.value
            for batch in batches:
                for r in range(batch.num_rows):
                    blob = {n: np.frombuffer(batch.column(n)[r].as_buffer(), t) for n, t in (("vectors", np.float64), ("starts", np.int64), ("rows", np.int32), ("places", np.int32))}
                    starts, held = blob["starts"], blob["vectors"].reshape(-1, points.shape[1])
                    lists = batch.column("ids")[r].values
                    first, ids = np.asarray(lists.offsets) - lists.offsets[0].as_py(), np.asarray(lists.flatten())
                    out, every = [], np.arange(len(held))
                    for q in range(len(names)):
                        spans = [(starts[p], starts[p + 1]) for p in near[q]]
                        mine = np.repeat(np.arange(places, dtype=np.int32), [e - s for s, e in spans])
                        theirs = np.concatenate([blob["places"][s:e] for s, e in spans])
                        shared = np.bincount(np.concatenate([blob["rows"][s:e] for s, e in spans]), places - np.maximum(mine, theirs), len(held))
                        # the footrule distance is places * (places + 1) - 2 * shared
                        chosen = every if len(held) <= candidates else np.flatnonzero(shared >= np.partition(shared, -candidates)[-candidates])
                        out.append(_best(held, first, ids, chosen, points[q], keep))
                    count = [len(x) for x, _ in out]
                    columns = [pa.array(np.repeat(np.array(names, object), count), pa.string()), pa.array(np.concatenate([i for _, i in out]), pa.int64()), pa.array(np.concatenate([f for f, _ in out]), pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["_c", "id", "score"])

        top = index.shards.mapInArrow(looked_up, _FOUND).withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= keep)
        top = top.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("_top"))
        before = spark.conf.get(_BATCH)
        spark.conf.set(_BATCH, "1")  # a shard at a time
        try:
            found.append(table(top, "vector-found"))
        finally:
            spark.conf.set(_BATCH, before)
        sent.unpersist()
    if not found:
        return members.selectExpr("_id AS query_id", "0 AS rank", "_id AS vec_id", "CAST(0 AS double) AS score").limit(0)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    others = F.slice(F.filter("_top", lambda x: ~((x["id"] == F.col("_id")) & (x["score"] == 0))), 1, k)
    out = members.join(every, "_c").select(F.col("_id").alias("query_id"), F.posexplode(others).alias("_p", "_x"))
    return out.select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.id").alias("vec_id"), F.col("_x.score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(build(vectors), vectors.filter(F.col("vec_id") % 100 == 0))
