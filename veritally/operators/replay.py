"""Replaying routing policies on a full table of answers: a contextual bandit that learns only from what it asked for."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .record import Posterior, probability
from .walks import walk

POLICIES = ("memory", "success_counts", "random")
LOG = "policy string, mode string, calls int, seed long, pos long, seq long, first int, committed int, used int, hit int, first_hit int"


class _Run:
    """A run along its events: who is asked first, who is asked on, and what is learned."""

    def __init__(self, policy: str, mode: str, calls: int, seed: int, dim: int, sources: int, precision: float):
        self.policy, self.mode, self.calls, self.rng = policy, mode, calls, np.random.default_rng(seed)
        # sources' blocks never mix, so each has a posterior of its own
        self.state = [Posterior(dim, 1, precision) for _ in range(sources)] if policy == "memory" else None
        self.counts = np.ones((sources, 2))

    def order(self, x: np.ndarray) -> np.ndarray:
        if self.state is not None:
            read = [s.read(x) for s in self.state]
            chance = probability([float(m[0, 0]) for m, _ in read], [float(v[0]) for _, v in read])
            return np.argsort(-(chance + 1e-9 * self.rng.random(len(chance))))
        if self.policy == "success_counts":
            return np.argsort(-self.rng.beta(self.counts[:, 0], self.counts[:, 1]))
        return self.rng.permutation(len(self.counts))

    def event(self, x: np.ndarray, labels, rejected) -> list[int]:
        """The sources asked, in order; the last is committed."""
        order = self.order(x)
        asked = [int(order[0])]
        for source in order[1 : self.calls] if self.mode != "none" else []:
            if not rejected[asked[-1]]:
                break
            asked.append(int(source))
        for source in asked[-1:] if self.mode == "final" else asked:
            if self.state is not None:
                self.state[source].write(x, 1.0 if labels[source] else -1.0)
            self.counts[source, 0 if labels[source] else 1] += 1
        return asked


def replay(events: DataFrame, runs: list[tuple[str, str, int, int]], precision: float = 100.0) -> DataFrame:
    """The decision log of every run (policy, mode, calls, seed) over events (pos, seq, address, labels, rejected).

    mode: `none` commits the first report; `all` asks on while reports are rejected and learns from all asked for; `final`
    learns from the committed one only. A run is sequential; runs go in parallel, and a worker holds a batch of events and a run's state.
    """
    for policy, *_ in runs:
        if policy not in POLICIES:
            raise ValueError(f"unknown policy {policy!r}")
    named = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("policy", "mode", "calls", "seed"), (p, m, int(c), int(k)), strict=True)]) for p, m, c, k in runs])
    kinds = {"calls": "int", "seed": "long"}
    each = events.select("pos", "seq", "address", "labels", "rejected", F.explode(named).alias("_run"))
    each = each.select(*[F.col(f"_run.{n}").cast(kinds.get(n, "string")).alias(n) for n in ("policy", "mode", "calls", "seed")], "pos", "seq", "address", "labels", "rejected")

    def start(row):
        return _Run(row["policy"], row["mode"], row["calls"], row["seed"], len(row["address"]) + 1, len(row["labels"]), precision)

    def step(run, row):
        asked = run.event(np.append(np.array(row["address"], float), 1.0), row["labels"], row["rejected"])
        first, last = asked[0], asked[-1]
        return {**{n: row[n] for n in ("policy", "mode", "calls", "seed", "pos", "seq")}, "first": first, "committed": last, "used": len(asked), "hit": int(row["labels"][last]), "first_hit": int(row["labels"][first])}

    return walk(each, ["policy", "mode", "calls", "seed"], ["pos"], start, step, LOG)


def replay_metrics(log: DataFrame) -> DataFrame:
    """Accuracy, calls and first accuracy of a run, averaged over seeds."""
    one = log.groupBy("policy", "mode", "calls", "seed").agg(F.avg("hit").alias("accuracy"), F.avg("used").alias("worker_calls"), F.avg("first_hit").alias("first_accuracy"))
    return one.groupBy("policy", "mode", "calls").agg(*[F.avg(c).alias(c) for c in ("accuracy", "worker_calls", "first_accuracy")])


def task_success(rows: DataFrame, task: str, hit: str) -> DataFrame:
    """Tasks, and those all of whose sub-tasks are right."""
    return rows.groupBy(task).agg(F.min(F.col(hit).cast("int")).alias("_all")).agg(F.count("*").alias("tasks"), F.sum("_all").cast("long").alias("solved"))


def check_quality(reports: DataFrame, source: str, right: str, rejected: str) -> DataFrame:
    """By source and over all (source null): share right, share rejected, wrong ones caught, right ones rejected, in percent."""
    y, r = F.col(right) == 1, F.col(rejected) == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    pct = lambda a, b, name: F.bround(F.lit(100.0) * a.cast("double") / F.greatest(F.lit(1), b).cast("double"), 2).alias(name)
    rows = reports.groupingSets([[], [source]], source)
    return rows.agg(F.grouping(source).cast("int").alias("overall"), F.count("*").alias("reports"), pct(n(y), F.count("*"), "right_share"), pct(n(r), F.count("*"), "rejected_share"), pct(n(r & ~y), n(~y), "wrong_caught"), pct(n(r & y), n(y), "right_rejected"))
