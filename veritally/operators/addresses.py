"""Addresses of events: features standardised, projected on principal components, scaled.

The fit needs sums and cross-products only: each task gives one row of sums, and these are added in a tree, so one matrix of
the features' number squared reaches the driver; rows never leave their tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


@dataclass
class Projection:
    mean: np.ndarray
    std: np.ndarray
    basis: np.ndarray
    scale: float

    def apply(self, df: DataFrame, features: str, name: str = "address") -> DataFrame:
        """Add the address of every row; null where the features are."""
        schema = StructType([*[f for f in df.schema.fields if f.name != name], StructField(name, ArrayType(DoubleType()))])

        def run(batches):
            for batch in batches:
                rows = [None if x is None else (((np.asarray(x, float) - self.mean) / self.std) @ self.basis / self.scale).tolist() for x in batch.column(features).to_pylist()]
                kept = [n for n in batch.schema.names if n != name]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(rows, pa.list_(pa.float64()))], [*kept, name])

        return df.mapInArrow(run, schema)


def _added(parts: DataFrame) -> DataFrame:
    """The sums of a partition's rows of (n, first, second), as one row."""

    def run(batches):
        n, first, second = 0, 0.0, 0.0
        for batch in batches:
            for a, b, c in zip(*(batch.column(k) for k in range(3)), strict=True):
                n, first, second = n + a.as_py(), first + np.frombuffer(b.as_buffer()), second + np.frombuffer(c.as_buffer())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([first.tobytes()]), pa.array([second.tobytes()])], ["n", "first", "second"])

    return parts.mapInArrow(run, "n long, first binary, second binary")


def fit(df: DataFrame, features: str, dim: int, branches: int = 8) -> Projection:
    """Principal components of the standardised features; fewer than dim if the features or rows are fewer.

    The features are read once: each task gives its sums, which are added in a tree, and one row comes to the driver.
    """

    def run(batches):
        n, first, second = 0, 0.0, 0.0
        for batch in batches:
            rows = [x for x in batch.column(0).to_pylist() if x is not None]
            if rows:
                x = np.asarray(rows, float)
                n, first, second = n + len(x), first + x.sum(0), second + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.asarray(first).tobytes()]), pa.array([np.asarray(second).tobytes()])], ["n", "first", "second"])

    parts = df.select(features).mapInArrow(run, "n long, first binary, second binary")
    total = _added(_added(parts.repartition(branches)).repartition(1)).first()
    if total is None:
        raise ValueError("no features to fit to")
    n, first = total["n"], np.frombuffer(total["first"])
    mean = first / n
    cross = np.frombuffer(total["second"]).reshape(len(mean), -1) - n * np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cross), 0) / max(1, n - 1)) + 1e-3
    cov = cross / np.outer(std, std)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[: min(dim, len(mean), n)]
    basis = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
    # the spread of all projected numbers together, whose mean is 0
    scale = float(np.sqrt(max(values[order].sum(), 0) / max(1, n * len(order) - 1))) + 1e-6
    return Projection(mean, std, basis, scale)


def save(projections: dict[str, Projection], spark, path: str) -> None:
    """Projections by name, a row each: what a walk without features begins with."""
    rows = [(k, p.mean.tolist(), p.std.tolist(), p.basis.ravel().tolist(), p.basis.shape[1], p.scale) for k, p in projections.items()]
    spark.createDataFrame(rows, "name string, mean array<double>, std array<double>, basis array<double>, dim int, scale double").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> dict[str, Projection]:
    return {r["name"]: Projection(np.array(r["mean"]), np.array(r["std"]), np.array(r["basis"]).reshape(-1, r["dim"]), r["scale"]) for r in spark.read.parquet(path).collect()}
