"""The steps of a plan that need no model: streams, own answers, combination, tables. Results are Parquet, published whole.

A stream is long: (seq, id, task_type, slot, peer, response, correct), and `misled` where answers were replaced. Answers of a
source are (id, response, correct), with accepted and forced for misleading ones; an evaluation is (id, correct, generation);
a record is (id, seq, task, trust, own_prob).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arbitration, joins, regimes
from ..operators.order import permutation, position
from ..sources.jsonl import publish
from .planner import Work
from .tables import pivoted

STREAM = ["seq", "id", "task_type", "slot", "peer", "response", "correct"]


def answers_of(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """Answers of several sources, a folder each, in the order given: slot and peer (the folder's name) beside them."""
    found = None
    for slot, path in enumerate(paths):
        rows = spark.read.parquet(path).withColumn("slot", F.lit(slot)).withColumn("peer", F.lit(path.rstrip("/").rsplit("/", 1)[-1]))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    if found is None:
        raise ValueError("a stream needs the answers of a source at least")
    return found


def add(events: DataFrame, answers: DataFrame, sources: int) -> DataFrame:
    """The events that all sources have answered, a row an answer."""
    one = answers.groupBy("id", "slot").agg(F.max(F.struct("peer", "response", "correct")).alias("a")).select("id", "slot", "a.*")
    whole = one.groupBy("id").agg(F.count("*").alias("_n")).filter(F.col("_n") == sources).select("id")
    return events.select("seq", "id", "task_type").join(one.join(whole, "id"), "id").select(*STREAM)


def replaced(stream: DataFrame, misleading: DataFrame, regime: regimes.Regime, walk: DataFrame, drop_forced: bool = False) -> DataFrame:
    """The stream with the answers that a regime takes replaced; `misled`, `selected`, `usable`, `forced` tell which and why."""
    events = stream.select("seq").distinct().count()
    bad = misleading.select("id", "slot", F.col("response").alias("_response"), F.col("correct").alias("misleading_correct"), F.coalesce("accepted", F.lit(True)).alias("_accepted"), F.coalesce("forced", F.lit(False)).alias("_forced"))
    both = stream.join(bad, ["id", "slot"], "left").join(walk.select("seq", position(F.col("pos"), events).alias("position")), "seq")
    both = both.withColumns({"forced": F.coalesce("_forced", F.lit(False)), "usable": F.coalesce("_accepted", F.lit(False)) & ~(F.coalesce("_forced", F.lit(False)) & F.lit(drop_forced))})
    chosen = regimes.replace(regimes.select_answers(both, regime, events, peer="slot"))
    text = F.when(F.col("misled"), F.col("_response")).otherwise(F.col("response"))
    return chosen.withColumns({"response": text, "before": F.col("correct"), "correct": F.col("label")}).select(*STREAM, "misled", "selected", "usable", "forced", "before")


def regime_of(spec, name: str) -> regimes.Regime:
    """A regime by its short name or by its settings."""
    found = regimes.shorthand(spec) if isinstance(spec, str) else regimes.Regime(name, **{k: tuple(v) if isinstance(v, list) else v for k, v in spec.items()})
    if found is None:
        raise ValueError(f"unknown regime {spec!r}")
    return found


def streams(spark: SparkSession, work: Work) -> None:
    base, *paths = work.reads
    if work.settings["how"] == "add":
        publish(add(spark.read.parquet(base).select("seq", "id", "task_type").distinct(), answers_of(spark, tuple(paths)), len(paths)), work.makes)
        return
    stream = spark.read.parquet(base)
    walk = permutation(spark, stream.select("seq").distinct().count(), work.settings["order"])
    out = replaced(stream, answers_of(spark, tuple(paths)), regime_of(work.settings["regime"], work.name), walk, work.settings["drop_forced"])
    publish(out, work.makes)
    manifest = regimes.replacement_manifest(spark.read.parquet(work.makes).withColumn("label", F.col("correct")).withColumn("correct", F.col("before")))
    publish(manifest.coalesce(1), f"{work.makes.rstrip('/')}.manifest", "json")


def own(spark: SparkSession, work: Work) -> None:
    """A stream with the model's own answers as the last ones; the evaluation itself is a model's work."""
    if work.settings.get("how") != "own":
        raise RuntimeError(f"{work.name}: a model makes {work.makes}")
    stream, answers = (spark.read.parquet(p) for p in work.reads)
    last = stream.groupBy("seq", "id", "task_type").agg((F.max("slot") + 1).alias("slot"))
    mine = last.join(answers.select(F.col("id"), F.col("generation").alias("response"), "correct"), "id").withColumn("peer", F.lit("own")).select(*STREAM)
    publish(stream.join(mine.select("seq"), "seq", "left_semi").unionByName(mine, allowMissingColumns=True), work.makes)


def combination(spark: SparkSession, work: Work) -> None:
    """Which of the two answers is final, by the reading line along the record, and its summary beside it."""
    record, read, alone = (spark.read.parquet(p) for p in work.reads)
    both = joins.with_generations(record, read, alone, skip_missing=bool(work.settings.get("skip_missing")))
    lines = arbitration.combined(arbitration.reading_line(both, prior=tuple(work.settings["prior"]), precision=float(work.settings["precision"])))
    out = lines.withColumn("generation", F.when(F.col("reads"), F.col("read_generation")).otherwise(F.col("alone_generation")))
    publish(out, work.makes)
    publish(arbitration.combination_metrics(spark.read.parquet(work.makes)).coalesce(1), f"{work.makes.rstrip('/')}.metrics", "json")


def table(spark: SparkSession, work: Work) -> None:
    """Accuracy of every result, a row a stream and a column a condition; a dash where there is none."""
    rows = []
    for path in work.reads:
        *_, stream, condition = path.rstrip("/").split("/")
        rows.append(spark.read.parquet(path).agg(F.lit(stream).alias("stream"), F.lit(condition).alias("condition"), F.avg(F.col("correct").cast("double")).alias("accuracy")))
    if not rows:
        raise ValueError("a table needs a result at least")
    metrics = rows[0]
    for r in rows[1:]:
        metrics = metrics.union(r)
    columns = list(dict.fromkeys(p.rstrip("/").rsplit("/", 1)[-1] for p in work.reads))
    publish(pivoted(metrics, "stream", "condition", "accuracy", columns).coalesce(1), work.makes)


STEPS = {"streams": streams, "own": own, "combination": combination, "table": table}
