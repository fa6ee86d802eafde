"""Walking ordered groups with a state, in the memory of one batch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def walk(df: DataFrame, keys: list[str], order: list[str], start: Callable[[dict], object], step: Callable[[object, dict], dict], schema: str) -> DataFrame:
    """Rows of each group in order, one at a time: `start(row)` makes the state of a group at its first row, `step(state, row)`
    changes it and gives the row's result.

    A group is sequential by what it is, so it is one task's work; but rows are sorted outside Python (spilling if need be)
    and come in batches, so a worker holds a batch and a state, however long the group is. Groups run in parallel.
    """
    fields = StructType.fromDDL(schema).fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                group = tuple(row[k] for k in keys)
                if group != now or state is None:
                    now, state = group, start(row)
                out.append(step(state, row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in out], arrow.field(f).type) for f in fields], fields)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
