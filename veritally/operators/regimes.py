"""Regimes: which answers of a stream are replaced by misleading ones."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_fraction

KINDS = ("fraction", "targeted", "flip", "count")


@dataclass(frozen=True)
class Regime:
    name: str
    kind: str = "fraction"
    rate: float = 0.0
    peers: tuple[int, ...] | None = None
    at: float = 0.0
    seed: int = 0
    exact: bool = False
    count: int = 0
    note: str = ""

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"regime {self.name}: unknown kind {self.kind!r}")
        if not 0 <= self.rate <= 1:
            raise ValueError(f"regime {self.name}: rate must be in [0, 1], got {self.rate}")
        if self.count < 0:
            raise ValueError(f"regime {self.name}: count must be >= 0, got {self.count}")

    def covers(self, peer: Column) -> Column:
        return F.lit(True) if self.peers is None else peer.isin(*self.peers)

    def key(self, peer: Column, event: Column) -> Column:
        """Place of an event in a peer's order; exact regimes share one order, so their choices nest."""
        return stable_fraction(self.seed, "sweep" if self.exact else self.name, peer, event)


def shorthand(name: str) -> Regime | None:
    """`pNNN`: NNN % of every peer's answers, exactly; `kN`: N peers of every event."""
    if (m := re.fullmatch(r"p(\d{3})", name)) and int(m[1]) <= 100:
        return Regime(name, "fraction", int(m[1]) / 100, exact=True)
    if m := re.fullmatch(r"k(\d+)", name):
        return Regime(name, "count", count=int(m[1]))
    return None


def select_answers(answers: DataFrame, regime: Regime, events: int, event: str = "id", peer: str = "peer", usable: str = "usable", position: str = "position", honest: str = "correct") -> DataFrame:
    """Add `selected`: whether the regime takes this answer.

    Exact fractions rank a peer's usable events by hash. The rank is found by a threshold first: hashes are cut into
    ranges by their leading digits and only the range with the last place is ordered.
    """
    p, e = F.col(peer), F.col(event)
    covered = regime.covers(p)
    if regime.kind == "count":
        rank = F.row_number().over(Window.partitionBy(event).orderBy("_u", peer))
        answers = answers.withColumn("_open", covered & F.col(usable)).withColumn("_u", F.when(F.col("_open"), stable_fraction(regime.seed, "count", e, p)).otherwise(F.lit(2.0)))
        return answers.withColumn("selected", F.col("_open") & (rank <= regime.count)).drop("_u", "_open")
    if regime.kind == "flip":
        return answers.withColumn("selected", covered & (F.col(position) >= regime.at))
    if regime.kind == "fraction" and regime.exact:
        want = round(regime.rate * events)
        ranges = 4096
        answers = answers.withColumn("_open", covered & F.col(usable)).withColumn("_u", regime.key(p, e)).withColumn("_r", F.floor(F.col("_u") * ranges))
        sizes = answers.filter("_open").groupBy(peer, "_r").agg(F.count("*").alias("_c"))
        before = Window.partitionBy(peer).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).select(F.col(peer).alias("_peer"), F.col("_r").alias("_range"), "_before")
        out = answers.join(sizes, (F.col(peer) == F.col("_peer")) & (F.col("_r") == F.col("_range")), "left")
        rank = F.row_number().over(Window.partitionBy(peer, "_r", "_open").orderBy("_u", event))
        return out.withColumn("selected", F.col("_open") & (F.coalesce("_before", F.lit(0)) + rank <= want)).drop("_open", "_u", "_r", "_peer", "_range", "_before")
    chosen = covered & (stable_fraction(regime.seed, regime.name, p, e) < regime.rate)
    return answers.withColumn("selected", chosen & (F.col(honest) == 1) if regime.kind == "targeted" else chosen)


def replace(selected: DataFrame, label: str = "correct", misleading_label: str = "misleading_correct", usable: str = "usable") -> DataFrame:
    """Add `misled` and the label in the stream: selected answers that are usable are replaced, others stay."""
    misled = F.col("selected") & F.col(usable)
    return selected.withColumn("misled", misled).withColumn("label", F.when(misled, F.col(misleading_label)).otherwise(F.col(label)).cast("int"))


def replacement_manifest(replaced: DataFrame, peer: str = "peer", label: str = "correct") -> DataFrame:
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    selected, misled = F.col("selected"), F.col("misled")
    return replaced.groupBy(peer).agg(
        F.count("*").alias("events"),
        count(F.col("usable")).alias("usable_answers"),
        count(selected).alias("selected_answers"),
        count(misled).alias("misled_answers"),
        count(misled & F.col("forced")).alias("forced_answers"),
        count(selected & ~misled).alias("unavailable"),
        F.sum(F.col(label).cast("long")).alias("rights_before"),
        F.sum(F.col("label").cast("long")).alias("rights_after"),
    )


def misled_histogram(replaced: DataFrame, event: str = "id") -> DataFrame:
    """How many events have so many misled answers."""
    return replaced.groupBy(event).agg(F.sum(F.col("misled").cast("int")).cast("int").alias("misled_peers")).groupBy("misled_peers").agg(F.count("*").alias("events"))
