"""A record over event time: events come out of order, and each is read and written when the watermark has passed it.

State of a key: the events that wait, one entry of a map each (so a new event changes one entry, not the whole state), and the posterior. An
event registers a timer for its time. When the watermark passes it, all waiting events up to the watermark are walked in the order of (time, id): each is read
from what was before it, then written, and its entry goes. So what waits is what lies within the lateness allowed; events later than that never
reach the state, as they could no longer be read in their place. A key of which nothing comes for `forget` is cleared.

The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass), which keeps state on disk and restarts from the checkpoint.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.record import Posterior, probability

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InTime(StatefulProcessor):
    """Input (key, id, at in milliseconds, address, labels); output (key, id, at, mean, variance, probability)."""

    def __init__(self, key: str, dim: int, heads: int, precision: float, keep: float, forget: int | None):
        self.key, self.dim, self.heads, self.precision, self.keep, self.forget = key, dim, heads, precision, keep, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, id string", "address array<double>, labels array<int>")
        self.memory = handle.getValueState("memory", "memory binary")
        self.seen = handle.getValueState("seen", "walked long, last long")

    def handleInputRows(self, key, rows, timerValues):
        walked, last = self.seen.get() if self.seen.exists() else (-1, -1)
        times = set()
        for batch in rows:
            for i, at, address, labels in zip(batch["id"], batch["at"], batch["address"], batch["labels"], strict=True):
                self.waiting.updateValue((int(at), str(i)), ([float(x) for x in address], [int(y) for y in labels]))
                times.add(int(at))
        for at in times:
            self.handle.registerTimer(at)
            last = max(last, at)
        if self.forget is not None and times:
            self.handle.registerTimer(last + self.forget)
        self.seen.update((walked, last))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, expired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        walked, last = self.seen.get() if self.seen.exists() else (-1, -1)
        over = self.forget is not None and last >= 0 and expired == last + self.forget
        out = []
        if over or expired > walked:  # else an earlier timer of this round has walked all that is due
            out = self._walk(key, now)
        if over:  # timers of one round come in any order, so what was due has been walked before the key is cleared
            for state in (self.waiting, self.memory, self.seen):
                state.clear()
        elif out:
            self.seen.update((max(now, expired), last))
        yield pd.DataFrame(out, columns=[self.key, "id", "at", "mean", "variance", "probability"]) if out else pd.DataFrame()

    def _walk(self, key, now: int) -> list[tuple]:
        """Read and write the events that the watermark has passed, in order."""
        due = sorted((k, v) for k, v in self.waiting.iterator() if k[0] <= now)
        if not due:
            return []
        record = Posterior(self.dim + 1, self.heads, self.precision, self.keep)
        if self.memory.exists():
            record.restore(bytes(self.memory.get()[0]))
        out = []
        for (at, i), (address, labels) in due:
            x = np.append(np.array(address), 1.0)
            mean, variance = record.read(x)
            out.append((key[0], i, at, mean[0].tolist(), float(variance[0]), probability(mean[0], variance[0]).tolist()))
            record.write(x, 2.0 * np.array(labels) - 1)
            self.waiting.removeKey((at, i))
        self.memory.update((record.snapshot(),))
        return out

    def close(self) -> None:
        pass


def record_in_time(events: DataFrame, key: str, time: str, dim: int, heads: int, late: str = "10 minutes", precision: float = 100.0, keep: float = 1.0, forget_seconds: int | None = None) -> DataFrame:
    """(key, id, at, mean, variance, probability) of a stream of (key, id, time, address, labels), in the order of time for each key.

    An event comes out when the watermark (the latest time less `late`) has passed it. Rows equal in key, time and id are one.
    """
    kind = dict(events.dtypes)[key]
    rows = events.withWatermark(time, late).select(key, F.col("id").cast("string").alias("id"), time, F.unix_millis(F.col(time).cast("timestamp")).alias("at"), F.col("address").cast("array<double>").alias("address"), F.col("labels").cast("array<int>").alias("labels"))
    processor = InTime(key, dim, heads, precision, keep, None if forget_seconds is None else 1000 * forget_seconds)
    schema = f"{key} {kind}, id string, at long, mean array<double>, variance double, probability array<double>"
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
