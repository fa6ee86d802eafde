"""The record along a stream in parallel blocks: the same reads as the walk, without one task a stream.

A write is an affine step of the state: the precision becomes keep * precision + (1 - keep) * prior + x x', the moments keep * moments + outcome x'. n
steps are one such step again, so a block's n writes are summed up in one matrix and one row a head, whatever state they start from:

1. every block of `block` places sums up its own writes (a task a block);
2. the blocks' sums are walked in order, one small step a block, which gives the state at the start of each (rows are blocks, not events);
3. every block is walked from its state (a task a block).

The result equals `record.fold` but for the order in which numbers are added. What a task holds is a block of a stream and a state.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .record import Posterior, evidence, probability
from .walks import walk


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def fold_in_blocks(events: DataFrame, key: str, pos: str = "seq", address: str = "address", labels: str = "labels", write: str | None = None, precision: float = 100.0, keep: float = 1.0, block: int = 20_000) -> DataFrame:
    """(key, pos, mean, variance, probability, evidence) of each event, read before it is written, as by `record.fold` with the rule `posterior`.

    `pos` is a whole number; places need not be dense, a block spans `block` of them. Addresses of a key have one length (a constant is appended), its labels one number of
    heads. Events whose `write` is false are read only: they neither write nor decay.
    """
    kinds = dict(events.dtypes)
    rows = events.select(F.col(key).alias("_key"), F.col(pos).alias("_pos"), F.col(address).cast("array<double>").alias("_x"), F.col(labels).cast("array<double>").alias("_y"), (F.coalesce(F.col(write), F.lit(False)) if write else F.lit(True)).alias("_write"))
    rows = rows.withColumn("_block", F.floor(F.col("_pos") / block))

    def parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = _matrix(table["_x"])
        return np.column_stack([x, np.ones(len(x))]), 2 * _matrix(table["_y"]) - 1, np.asarray(table["_write"].combine_chunks().to_pylist(), bool)

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        x, y, written = parts(table)
        x, y = x[written], y[written]
        weight = keep ** np.arange(len(x) - 1, -1, -1.0)
        total, moment = (x * weight[:, None]).T @ x, (y * weight[:, None]).T @ x
        columns = [table["_key"].slice(0, 1).combine_chunks(), table["_block"].slice(0, 1).combine_chunks(), pa.array([len(x)], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64())), pa.array([moment.ravel().tolist()], pa.list_(pa.float64()))]
        return pa.table(columns, ["_key", "_block", "n", "total", "moment"])

    sums = rows.groupBy("_key", "_block").applyInArrow(summed, f"_key {kinds[key]}, _block long, n long, total array<double>, moment array<double>")

    def start(row):
        dim = round(len(row["total"]) ** 0.5)
        return {"total": precision * np.eye(dim).ravel(), "moment": np.zeros(len(row["moment"])), "prior": precision * np.eye(dim).ravel()}

    def step(state, row):
        before = {"_key": row["_key"], "_block": row["_block"], "total": state["total"].tolist(), "moment": state["moment"].tolist()}
        kept = keep ** row["n"]
        state["total"] = kept * state["total"] + (1 - kept) * state["prior"] + np.array(row["total"])
        state["moment"] = kept * state["moment"] + np.array(row["moment"])
        return before

    states = walk(sums, ["_key"], ["_block"], start, step, f"_key {kinds[key]}, _block long, total array<double>, moment array<double>")

    def read(table: pa.Table, state: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        x, y, written = parts(table)
        dim, heads = x.shape[1], y.shape[1]
        record = Posterior(dim, heads, precision, keep)
        total = _matrix(state["total"])[0].reshape(dim, dim).copy()
        record.matrix = np.linalg.inv(total) if keep == 1 else total
        record.moment = _matrix(state["moment"])[0].reshape(heads, dim).copy()
        means, variances, supports = np.empty((len(x), heads)), np.empty(len(x)), []
        for k in range(len(x)):
            mean, variance = record.read(x[k])
            means[k], variances[k] = mean[0], variance[0]
            supports.append(evidence(x[k], precision, float(variance[0])))
            if written[k]:
                record.write(x[k], y[k])
        chance = probability(means, variances[:, None]) if len(x) else means
        lists = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, heads, dtype=np.int32), pa.array(a.ravel()))
        return pa.table([table["_key"], table["_pos"], lists(means), pa.array(variances), lists(np.asarray(chance)), pa.array(supports, pa.float64())], [key, pos, "mean", "variance", "probability", "evidence"])

    schema = f"{key} {kinds[key]}, {pos} {kinds[pos]}, mean array<double>, variance double, probability array<double>, evidence double"
    return rows.groupBy("_key", "_block").cogroup(states.groupBy("_key", "_block")).applyInArrow(read, schema)
