"""Reading and writing streams of events and answers as JSON lines."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tasks
from ..operators.streams import last_wins

EVENT = """id string, uid string, task_type string, source string, problem string, question string, answer string,
answer_aliases array<string>, aliases array<string>, context string, choices array<string>, choice_labels array<string>,
code_format string, test string, test_setup string, entry_point string, test_cases array<struct<input:string,output:string>>,
peer_responses map<string,string>, peer_correct map<string,double>, correctness_by_peer map<string,int>,
peer_metadata map<string,struct<model:string,received_context:boolean,num_samples:int,regime:string,misled:boolean,adversarial_forced:boolean,adversarial_attempts:int>>,
team struct<task:string,sub_task:int,sub_tasks:int,kind:string,last:boolean,support_retrieved:boolean>"""
ANSWER = "id string, source string, task_type string, response string, generation string, target double, correct int, turns int, accepted boolean, forced boolean, attempts int, reasons array<string>, soft array<string>"


def _context(raw: Column) -> Column:
    """A text, a list of texts, or a list of [title, [sentences]], as a list of texts."""
    texts = F.from_json(raw, "array<string>")
    nested = lambda p: F.from_json(p, "array<string>")
    passage = lambda p: F.when(F.startswith(p, F.lit("[")) & (F.size(nested(p)) == 2), F.concat(F.get(nested(p), 0), F.lit(": "), F.array_join(F.coalesce(F.from_json(F.get(nested(p), 1), "array<string>"), F.array(F.get(nested(p), 1))), " "))).otherwise(p)
    return F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>")).when(F.startswith(raw, F.lit("[")) & texts.isNotNull(), F.transform(texts, passage)).otherwise(F.array(raw))


def read_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Events with their place in the file as `seq`, and fields under one name each.

    Rows are in the order of the files' names, then of the lines: places come from the file, the block read and the line within
    it, not from how Spark packs files into partitions. Later steps never rely on scan order.
    """
    raw = spark.read.schema(EVENT).json(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    out = raw.withColumns(
        {
            "id": F.coalesce("id", "uid"),
            "task_type": F.lower(F.coalesce("task_type", F.lit("math"))),
            "problem": F.coalesce("problem", "question"),
            "answer_aliases": F.coalesce("answer_aliases", "aliases"),
            "context": _context(F.col("context")),
        }
    ).drop("uid", "question", "aliases")
    # a block is read by one task, line by line: its rows' ids ascend
    blocks = out.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_line").alias("_first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    shift = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = out.join(shift, ["_file", "_block"])
    return out.withColumn("seq", (F.col("_before") + F.col("_line") - F.col("_first")).cast("long")).drop("_file", "_block", "_line", "_before", "_first")


def long_answers(events: DataFrame, peers: int | None = None) -> DataFrame:
    """One row an event and source, in the order of the sources' names as text: id, seq, task_type, slot, peer, response, soft, hard.

    The hard label goes before the soft one, which is rounded with halves to even.
    """
    keys = F.array_sort(F.map_keys("peer_responses"))
    rows = events.select("id", "seq", "task_type", "peer_responses", "peer_correct", "correctness_by_peer", F.posexplode(keys if peers is None else F.slice(keys, 1, peers)).alias("slot", "peer"))
    pick = lambda m: F.try_element_at(F.col(m), F.col("peer"))
    soft = F.coalesce(pick("peer_correct"), pick("correctness_by_peer").cast("double"), F.lit(0.0))
    hard = F.coalesce(pick("correctness_by_peer"), F.bround(pick("peer_correct")).cast("int"), F.lit(0))
    return rows.select("id", "seq", "task_type", "slot", "peer", pick("peer_responses").alias("response"), soft.alias("soft"), hard.alias("hard"))


def read_answers(spark: SparkSession, pattern: str) -> DataFrame:
    """Answers of all shards, one row an id: a later file, and a later line, wins. Malformed lines are left out."""
    return _last_rows(spark, pattern, ANSWER)


def _last_rows(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(pattern)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")).filter(F.col("id").isNotNull())
    return last_wins(rows, "id", ["_file", "_block", "_line"]).drop("_file", "_block", "_line")


def evaluations_as_answers(generations: DataFrame) -> DataFrame:
    return generations.select(F.col("id").cast("string").alias("id"), F.col("generation").alias("response"), "correct")


def read_completed(spark: SparkSession, path: str) -> DataFrame:
    """Ids already written; lines that do not parse are skipped."""
    return spark.read.schema("id string").option("mode", "DROPMALFORMED").json(path).filter(F.col("id").isNotNull()).distinct()


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_by_peer(answers: DataFrame, path: str) -> None:
    """One folder a source."""
    answers.write.mode("overwrite").partitionBy("peer").json(path)


def file_checksums(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


def ordered_digest(rows: DataFrame, order: str, columns: list[str], block: int = 100_000) -> str:
    """sha256 over the sha256 of blocks of `block` rows in order; no task sees more than a block, the driver sees a hash a block.

    `order` numbers the rows (from 0); rows with one number go by their text.
    """
    text = F.to_json(F.struct(*columns))
    parts = rows.select(F.floor(F.col(order) / block).alias("b"), F.struct(F.col(order).alias("o"), F.sha2(text, 256).alias("t")).alias("r"))
    parts = parts.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), ""), 256).alias("h"))
    h = hashlib.sha256()
    for r in parts.orderBy("b").toLocalIterator():
        h.update(r.h.encode())
    return h.hexdigest()


VERDICT = "id string, verdicts array<string>, critiques array<string>"
GENERATION = "id string, generation string, correct int, history array<string>"


def read_verdicts(spark: SparkSession, pattern: str) -> DataFrame:
    """Verdicts on reports of all shards, one row an id: a later file, and a later line, wins."""
    return _last_rows(spark, pattern, VERDICT)


def read_generations(spark: SparkSession, pattern: str) -> DataFrame:
    """The model's answers, one row an id; ids are text."""
    return _last_rows(spark, pattern, GENERATION)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Events of compressed files; Spark unpacks by the names' endings, one task a file."""
    return read_events(spark, path)


def publish(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a result so that it is seen whole or not at all: beside its place first, then moved; an earlier one is replaced."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    part, whole = fs_path(f"{path.rstrip('/')}.part"), fs_path(path)
    df.write.mode("overwrite").format(kind).save(str(part))
    fs = whole.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(whole, True)
    if not fs.rename(part, whole):
        raise OSError(f"{part} could not be moved to {path}")


def write_manifest(df: DataFrame, path: str) -> None:
    """A small summary beside a stream, as JSON lines."""
    publish(df.coalesce(1), path, "json")


def write_graded(graded: DataFrame, metrics: DataFrame, path: str) -> None:
    """Graded generations and, once they are there, their metrics: where metrics are, the result is whole."""
    publish(graded, f"{path.rstrip('/')}/generations")
    publish(metrics.coalesce(1), f"{path.rstrip('/')}/metrics", "json")


def derived(spark: SparkSession, path: str, make) -> DataFrame:
    """A result that is kept: read where it is, made and published where it is not."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        publish(make(), path)
    return spark.read.parquet(path)


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a path, or an empty table where it is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def with_labels(events: DataFrame) -> DataFrame:
    """Events whose soft labels of sources are graded where they lack (`peer_correct` null); those with labels keep them."""
    names = F.array_sort(F.map_keys("peer_responses"))
    rest = events.filter(F.col("peer_correct").isNull())
    long = rest.select("seq", *[c for c in ("task_type", "problem", "answer", "answer_aliases", "choices", "choice_labels", "context") if c in events.columns], F.explode(names).alias("_peer"), "peer_responses")
    graded = tasks.graded(long.withColumn("_text", F.element_at("peer_responses", F.col("_peer"))), "_text")
    labels = graded.groupBy("seq").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_peer", "target")))).alias("_labels"))
    return events.join(labels, "seq", "left").withColumn("peer_correct", F.coalesce("peer_correct", "_labels")).drop("_labels")
