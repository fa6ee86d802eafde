"""The record and the arbitration as streams: the same results for any split into micro-batches.

Rows may arrive out of order; each key's state holds what has come early until its place is next, so that every read sees
exactly the earlier places. State lives in the state store and survives a restart from the checkpoint.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.record import Posterior, probability

_STATE = "place long, memory binary, early string"


def _in_order(state: GroupState, rows: list[tuple[int, list]], first: int, memory: bytes):
    """(rows whose place has come, memory, a function that saves)."""
    place, memory, early = state.get if state.exists else (first, memory, "{}")
    # a place that has passed (a row that came twice, or late) is over: it does not stay in the state
    waiting = json.loads(early) | {str(k): v for k, v in rows if k >= place}
    ready = []
    while str(place) in waiting:
        ready.append((place, waiting.pop(str(place))))
        place += 1

    def save(now: bytes):
        state.update((place, now, json.dumps(waiting)))

    return ready, bytes(memory), save


def record_stream(events: DataFrame, key: str, dim: int, heads: int, precision: float = 100.0, keep: float = 1.0, first: int = 0) -> DataFrame:
    """(key, pos, mean, variance, probability) of a stream of (key, pos, address, labels); places of a key count from `first`."""

    def run(name, batches, state: GroupState):
        new = [(int(p), [list(map(float, a)), list(map(int, y))]) for b in batches for p, a, y in zip(b["pos"], b["address"], b["labels"], strict=True)]
        blank = Posterior(dim + 1, heads, precision, keep)
        ready, memory, save = _in_order(state, new, first, blank.snapshot())
        blank.restore(memory)
        out = []
        for pos, (address, labels) in ready:
            x = np.append(address, 1.0)
            mean, variance = blank.read(x)
            out.append((name[0], pos, mean[0].tolist(), float(variance[0]), probability(mean[0], variance[0]).tolist()))
            blank.write(x, 2.0 * np.array(labels) - 1)
        save(blank.snapshot())
        yield pd.DataFrame(out, columns=[key, "pos", "mean", "variance", "probability"])

    kind = dict(events.dtypes)[key]
    rows = events.select(key, "pos", "address", "labels")
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, pos long, mean array<double>, variance double, probability array<double>", _STATE, "append", GroupStateTimeout.NoTimeout)


def arbitration_stream(events: DataFrame, task: str = "task", prior: tuple[float, float] = (0.5, 0.0), precision: float = 1.0, first: int = 0) -> DataFrame:
    """(task, pos, rho, delta, value, reads) of a stream of (task, pos, trust, own_prob, read_correct)."""

    def run(name, batches, state: GroupState):
        new = [(int(p), [float(t), float(k), float(y)]) for b in batches for p, t, k, y in zip(b["pos"], b["trust"], b["own_prob"], b["read_correct"], strict=True)]
        start = np.concatenate([(precision * np.eye(2)).ravel(), precision * np.array(prior)])
        ready, memory, save = _in_order(state, new, first, start.tobytes())
        held = np.frombuffer(memory).copy()
        p, q = held[:4].reshape(2, 2), held[4:]
        out = []
        for pos, (trust, own, right) in ready:
            rho, delta = np.linalg.solve(p, q)
            value = trust * rho + (1 - trust) * (own - delta)
            out.append((name[0], pos, float(rho), float(delta), float(value), bool(value >= own)))
            u = np.array([trust, trust - 1])
            p += np.outer(u, u)
            q += u * (right - (1 - trust) * own)
        save(held.tobytes())
        yield pd.DataFrame(out, columns=[task, "pos", "rho", "delta", "value", "reads"])

    kind = dict(events.dtypes)[task]
    rows = events.select(task, "pos", "trust", "own_prob", "read_correct")
    return rows.groupBy(task).applyInPandasWithState(run, f"{task} {kind}, pos long, rho double, delta double, value double, reads boolean", _STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts in event-time windows; rows later than `late` are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("window"), *by).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "events")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    window = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(window.alias("session"), by).agg(F.count("*").alias("events")).select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), by, "events")
