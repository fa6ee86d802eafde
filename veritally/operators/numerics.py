"""How a record's covariance fares in floating point along a stream: three ways to hold it, against exact sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .walks import walk


class ShortInverse:
    """The covariance itself, changed by rank one in the short form, which is symmetric at the exact gain only."""

    def __init__(self, dim: int, precision: float):
        self.held, self.mean = np.eye(dim) / precision, np.zeros(dim)

    def write(self, x: np.ndarray, outcome: float) -> None:
        gain = self.held @ x
        gain = gain / (1 + x @ gain)
        self.mean = self.mean + gain * (outcome - self.mean @ x)
        self.held = self.held - np.outer(gain, x @ self.held)

    def covariance(self) -> np.ndarray:
        return self.held


class SymmetricInverse(ShortInverse):
    """The covariance as (I - k x') P (I - x k') + k k', in pieces of rank one."""

    def write(self, x, outcome):
        right, left = self.held @ x, x @ self.held
        spread = 1 + x @ right
        gain = right / spread
        self.mean = self.mean + gain * (outcome - self.mean @ x)
        self.held = self.held - np.outer(gain, left) - np.outer(right, gain) + spread * np.outer(gain, gain)


class RootFactor:
    """A triangular root of the precision, R R' = precision: rotations bring a new address in, so that symmetry and
    definiteness cannot be lost."""

    def __init__(self, dim: int, precision: float):
        self.root, self.moment = np.eye(dim) * np.sqrt(precision), np.zeros(dim)

    def write(self, x: np.ndarray, outcome: float) -> None:
        self.moment = self.moment + outcome * x
        rest, root = np.array(x, float), self.root
        for k in range(len(rest)):
            if rest[k]:
                r = np.hypot(root[k, k], rest[k])
                c, s = root[k, k] / r, rest[k] / r
                column = root[k:, k].copy()
                root[k:, k] = c * column + s * rest[k:]
                rest[k:] = c * rest[k:] - s * column

    def covariance(self) -> np.ndarray:
        back = np.linalg.solve(self.root, np.eye(len(self.root)))
        return back.T @ back

    @property
    def mean(self) -> np.ndarray:
        return np.linalg.solve(self.root.T, np.linalg.solve(self.root, self.moment))


PATHS = {"short": ShortInverse, "symmetric": SymmetricInverse, "root": RootFactor}


class Study:
    """The three paths and the exact sums, written together."""

    def __init__(self, dim: int, precision: float):
        self.paths = {n: kind(dim, precision) for n, kind in PATHS.items()}
        self.sums, self.moment, self.writes = np.eye(dim) * precision, np.zeros(dim), 0

    def write(self, x: np.ndarray, outcome: float) -> None:
        for path in self.paths.values():
            path.write(x, outcome)
        self.sums += np.outer(x, x)
        self.moment += outcome * x
        self.writes += 1

    def report(self) -> list[dict]:
        """For each path: how unlike its transpose the covariance is, its least eigenvalue and trace, and how far covariance and
        mean are from the exact ones; norms are relative."""
        exact = np.linalg.inv(self.sums)
        mean = exact @ self.moment
        out = []
        for name, path in self.paths.items():
            held = path.covariance()
            out.append({
                "path": name,
                "asymmetry": float(np.linalg.norm(held - held.T) / np.linalg.norm(held)),
                "least_eigenvalue": float(np.linalg.eigvalsh((held + held.T) / 2)[0]),
                "trace": float(np.trace(held)),
                "covariance_drift": float(np.linalg.norm(held - exact) / np.linalg.norm(exact)),
                "mean_drift": float(np.linalg.norm(path.mean - mean) / max(np.linalg.norm(mean), 1e-12)),
            })
        return out


_REPORT = "path string, asymmetry double, least_eigenvalue double, trace double, covariance_drift double, mean_drift double"


def covariance_report(stream: DataFrame, key: str, pos: str, address: str = "address", label: str = "label", every: int = 20_000, precision: float = 100.0) -> DataFrame:
    """(key, writes, path, asymmetry, least_eigenvalue, trace, covariance_drift, mean_drift) every `every` writes of a key's stream, and at
    its last one. `label` is 0 or 1, `address` an array of numbers of one length in a key; keys are walked in parallel, in the memory of a batch.
    """
    ends = stream.groupBy(F.col(key).alias("_key")).agg(F.max(pos).alias("_end"))
    rows = stream.select(key, pos, F.col(address).cast("array<double>").alias("address"), F.col(label).cast("int").alias("label"))
    rows = rows.join(ends, rows[key].eqNullSafe(ends["_key"])).withColumn("_last", F.col(pos) == F.col("_end")).drop("_key", "_end")

    def start(row):
        return Study(len(row["address"]), precision)

    def one(state, row):
        state.write(np.array(row["address"]), 1.0 if row["label"] == 1 else -1.0)
        due = row["_last"] or state.writes % every == 0
        return {key: row[key], "writes": state.writes, "report": state.report() if due else None}

    walked = walk(rows, [key], [pos], start, one, f"{key} {dict(stream.dtypes)[key]}, writes long, report array<struct<{_REPORT.replace(' ', ':').replace(',:', ',')}>>")
    return walked.select(key, "writes", F.explode("report").alias("r")).select(key, "writes", "r.*")
