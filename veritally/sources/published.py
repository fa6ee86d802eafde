"""Results that are seen whole or not at all, and answers by source that are resumed where they are not whole.

A published result is a folder of versions and a small file that names the current one. A new version is written beside the others, and
then the file is replaced in one rename that overwrites (on HDFS, and on a local file system, a single step). Whoever reads gets the version that the file names, so a crash at
any moment leaves the old result or the new one, and readers at work keep their version until `sweep` removes it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "current.json"


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, place = _fs(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def replace(spark: SparkSession, path: str, content: dict) -> None:
    """A small file with the content, in one rename over the one that was there."""
    fs, place = _fs(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    _move_over(spark, fs.makeQualified(part), fs.makeQualified(place))


def _move_over(spark: SparkSession, part, place) -> None:
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), spark._jsc.hadoopConfiguration()).rename(part, place, how)


def publish_version(df: DataFrame, path: str, kind: str = "parquet", **about) -> str:
    """Write df as a new version of the result at `path` and make it the current one; gives its name. `about` is kept in the pointer."""
    name = uuid.uuid4().hex
    df.write.format(kind).save(f"{path.rstrip('/')}/versions/{name}")
    replace(df.sparkSession, f"{path.rstrip('/')}/{POINTER}", {"version": name, "kind": kind, **about})
    return name


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version; None where nothing has been published."""
    current = _read(spark, f"{path.rstrip('/')}/{POINTER}")
    return None if current is None else spark.read.format(current["kind"]).load(f"{path.rstrip('/')}/versions/{current['version']}")


def about(spark: SparkSession, path: str) -> dict | None:
    """What the pointer says."""
    return _read(spark, f"{path.rstrip('/')}/{POINTER}")


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Remove all versions but the current one, also what crashed runs left; gives their names. For when nothing is read or written."""
    current, (fs, folder) = about(spark, path), _fs(spark, f"{path.rstrip('/')}/versions")
    gone = []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        if current is None or name != current["version"]:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


# ---------------------------------------------------------------- answers by source

def _complete(spark: SparkSession, path: str) -> DataFrame:
    found = published(spark, f"{path.rstrip('/')}/complete")
    return spark.createDataFrame([], "source string, rows long") if found is None else found


def incomplete(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """The expected (source, rows) that are not complete at `path` with so many rows."""
    return expected.select("source", F.col("rows").cast("long").alias("rows")).join(_complete(spark, path), ["source", "rows"], "left_anti")


def unpack_by_source(answers: DataFrame, path: str, expected: DataFrame) -> DataFrame:
    """Write the answers of the sources that are not complete yet, each source a partition of `path`; gives (source, rows, expected) of what was
    written. Other sources are neither read further than their name nor written: their partitions stay as they are.

    `answers` has a column `source`; `expected` says how many answers each source must have. A source is complete when that many lie
    in its partition, and the list of complete sources is published last, in one rename. So a run that was cut off is resumed by calling this again:
    only what it had not completed is written anew, over what it had left. A source with another number of answers than expected stays incomplete.
    """
    spark = answers.sparkSession
    todo = incomplete(spark, path, expected)
    some = answers.join(todo.select("source"), "source", "left_semi")
    some.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{path.rstrip('/')}/answers")
    written = todo.withColumnRenamed("rows", "expected").join(stored_by_source(spark, path).groupBy("source").agg(F.count("*").alias("rows")), "source", "left")
    written = written.select("source", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "expected")
    rows = [(r["source"], r["rows"], r["expected"]) for r in written.collect()]  # a row a source, as in `expected`
    whole = spark.createDataFrame([r[:2] for r in rows if r[1] == r[2]], "source string, rows long")
    if any(r[1] == r[2] for r in rows):
        now = _complete(spark, path).join(whole.select("source"), "source", "left_anti").unionByName(whole)
        publish_version(now.coalesce(1), f"{path.rstrip('/')}/complete")
    return spark.createDataFrame(rows, "source string, rows long, expected long")


def stored_by_source(spark: SparkSession, path: str) -> DataFrame:
    """All answers at `path`, of whole sources or not."""
    fs, folder = _fs(spark, f"{path.rstrip('/')}/answers")
    if not fs.exists(folder) or not [s for s in fs.listStatus(folder) if s.getPath().getName().startswith("source=")]:
        return spark.createDataFrame([], "source string")
    out = spark.read.parquet(f"{path.rstrip('/')}/answers")
    return out.withColumn("source", F.col("source").cast("string"))


def answers_by_source(spark: SparkSession, path: str) -> DataFrame:
    """The answers of complete sources; their partitions alone are read."""
    names = [r["source"] for r in _complete(spark, path).select("source").collect()]
    return stored_by_source(spark, path).filter(F.col("source").isin(names))
