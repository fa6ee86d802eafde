"""What the operators share: intermediate tables, bounded samples, word and n-gram hashes over Arrow text."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Rows of an Arrow batch while an intermediate table is written: whole texts may be long.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary one; on a cluster that is an error, as executors share no local folder.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="veritally-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `table` made; nothing that is still to be computed may read them."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _sample_hash(key: str):
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.lit(1 << 30))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows (at most `rows`) with the least hash of key, ties by key; other columns come along.

    A filter on the hash, from the count of df, first leaves little more than `rows` rows, so that few are sorted.
    """
    df = df.withColumn("_h", _sample_hash(key))
    found = df.count()
    if found > rows:
        df = df.filter(F.col("_h") <= int((1 << 30) * min(1.0, (1.2 * rows + 100) / found)))
    return df.orderBy("_h", key).limit(rows).drop("_h")


# ---------------------------------------------------------------- bytes and words of an Arrow column

_LUT = np.zeros(256, bool)
_LUT[[0x20, *range(0x09, 0x0E)]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
#: Words of more bytes are hashed one by one.
_LONG = 48


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit generator: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls count as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of the texts of an Arrow string column: byte start and end, number of the text, 64-bit hash.

    `apart` says which bytes part words; `prepare` maps the bytes first, without moving them.
    """

    def __init__(self, column: pa.Array, apart: np.ndarray = _LUT, prepare=None):
        self.data, self.offsets = raw(column)
        if prepare is not None:
            self.data = prepare(self.data)
        data, offsets = self.data, self.offsets
        n = len(data)
        white = apart[data]
        before = np.ones(n + 1, bool)
        before[1:] = white
        before[offsets] = True
        after = np.ones(n + 1, bool)
        after[:n] = white
        after[offsets] = True
        self.start = np.flatnonzero(~white & before[:n])
        self.end = np.flatnonzero(~white & after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)  # text k has the words first[k] to first[k + 1]
        self.count = np.diff(self.first)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A polynomial in the bytes of each word, a place of all words at a time, longest words first."""
        size = self.end - self.start
        order = np.argsort(-np.minimum(size, _LONG + 1).astype(np.int8), kind="stable")
        start = self.start[order]
        running = len(size) - np.cumsum(np.bincount(np.minimum(size, _LONG + 1), minlength=_LONG + 2))
        h = np.zeros(len(size), np.uint64)
        for k in range(_LONG):
            n = int(running[k])
            if not n:
                break
            h[:n] = h[:n] * np.uint64(_BASE) + self.data[start[:n] + k] + np.uint64(1)
        out = np.empty_like(h)
        out[order] = h
        for k in order[: int(running[_LONG])]:
            out[k] = int.from_bytes(hashlib.blake2b(self.data[self.start[k] : self.end[k]].tobytes(), digest_size=8).digest(), "little")
        return mix(out ^ (size.astype(np.uint64) * _MULT))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they are words of one text."""
        return grams(self.hash, n), self.whole(n)

    def whole(self, n: int) -> np.ndarray:
        return np.arange(len(self.start)) + n <= np.repeat(self.first[1:], self.count)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n items from each place on (the last n - 1 are of no use)."""
    out, factor = np.zeros(len(hashes), np.uint64), 1
    for k in range(min(n, len(hashes))):
        out[: len(hashes) - k] += hashes[k:] * np.uint64(factor)
        factor = factor * _BASE % (1 << 64)
    return mix(out)


def chunks(batch: pa.RecordBatch, text: str, most: int = 2_000_000):
    """Slices of a batch of about `most` bytes of text each; a longer text is a slice of its own."""
    offsets = raw(batch.column(batch.schema.get_field_index(text)))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def is_remainder(key, parts: int, remainder: int):
    """Whether crc32 of the key as text leaves the remainder; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == remainder, F.lit(False))


#: Bytes of text of a labelled sample at most (the rows of least hash stay, one at least).
SAMPLE_BYTES = 64_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame | None, label: str, rows: int, parts: int, held: int, key: str = "doc_id", text: str = "text", most_bytes: int = SAMPLE_BYTES):
    """(texts, labels) of at most `rows` labelled rows of at most `most_bytes` in all, none held out, as numpy arrays on the driver.

    The rows are chosen by key before any text is read. A key with several labels counts with the greatest one, a key with
    several texts with the least, so the sample does not depend on the order of rows.
    """
    source = (labels if labels is not None else docs).select(key, label)
    chosen = source.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~is_remainder(key, parts, held)).groupBy(key).agg(F.max(label).alias(label))
    chosen = table(bounded_sample(chosen, key, rows), f"sample-{label}")
    found = docs.select(key, text).filter(F.col(text).isNotNull()).join(F.broadcast(chosen), key).groupBy(key, label).agg(F.min(text).alias(text))
    found = table(found.withColumn("_h", _sample_hash(key)).withColumn("_bytes", F.octet_length(text)), f"sampled-{label}")
    sizes = found.select("_h", key, "_bytes").toPandas().sort_values(["_h", key])
    fits = max(1, int((sizes["_bytes"].cumsum() <= most_bytes).sum()))
    if fits < len(sizes):
        last = sizes.iloc[fits - 1]
        found = found.filter((F.col("_h") < int(last["_h"])) | ((F.col("_h") == int(last["_h"])) & (F.col(key) <= F.lit(last[key].item() if hasattr(last[key], "item") else last[key]))))
    found = found.select(key, text, label).toPandas().sort_values(key)
    return found[text].to_numpy(object), found[label].to_numpy()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, gradient)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w
