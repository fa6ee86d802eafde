"""What the operators on vectors share: which rows take part, and vectors as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(df: DataFrame, vector: str, zeros: bool = True) -> DataFrame:
    """The rows with a vector of at least one component, all finite, as `_v` of doubles (-0.0 is 0.0); without zero vectors if asked."""
    df = df.drop("_v").withColumn("_v", F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)))
    there = F.forall("_v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    df = df.filter(F.col("_v").isNotNull() & (F.size("_v") > 0) & there)
    return df if zeros else df.filter(F.exists("_v", lambda x: x != 0))


def commonest_length(df: DataFrame) -> int:
    """The number of components that most vectors `_v` have, the least of several; 0 if there are no rows."""
    lengths = df.groupBy(F.size("_v").alias("_d")).agg(F.count("*").alias("_c"))
    found = lengths.agg(F.max(F.struct("_c", (-F.col("_d")).alias("_d"))).alias("_m")).first()["_m"]
    return 0 if found is None else -found["_d"]


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """An Arrow column of lists of one length as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=kind).reshape(len(column), -1)
