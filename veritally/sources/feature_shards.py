"""Feature shards as a Spark data source: `spark.read.format("feature_shards").load(folder)`.

A shard is a NumPy archive `shard*.npz` of some events' features: `places` (the events' numbers in the stream), `ids`, `question` and `meaning` (a row
an event), and, if the answers' parts were saved, `answers` (event, source, number) and `margins` (event, source). Shards come in any order and hold any places.

Reading plans one partition a shard. Each is checked where it is read: arrays of one length, an id for every place, the numbers of columns
that all shards must share. `joins.feature_stream` then checks ids against the events'. A folder that this source has written has an index (`shards.json`)
with every shard's rows, places and widths: only listed files are read, so what a failed or unfinished write left behind is never seen, and shards whose places
cannot hold what is asked for are not planned. What is asked for are filters on `seq`, and the options `first` and `last`
(places, last included). Without an index every `shard*.npz` of the folder is read, and filtered by its places.

Writing makes one shard of each partition that has rows, and the index in one rename at the end; mode("overwrite") removes the shards that the old index lists after that.
Paths may be of any store that Arrow's filesystems reach.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "seq long, id string, question array<float>, meaning array<float>, answers array<array<float>>, margins array<float>"
INDEX, BATCH = "shards.json", 1000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("/"):
        return fs.LocalFileSystem(), path.rstrip("/")
    store, inside = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store, inside.rstrip("/")


def _index(path: str) -> list[dict] | None:
    store, folder = _store(path)
    if store.get_file_info(f"{folder}/{INDEX}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{folder}/{INDEX}") as f:
        return json.loads(f.read())


def _listed(path: str) -> list[dict]:
    """The shards by name; without an index nothing but the names is known, and the widths of the first."""
    found = _index(path)
    if found is not None:
        return found
    store, folder = _store(path)
    names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(folder)) if x.base_name.startswith("shard") and x.base_name.endswith(".npz"))
    if not names:
        raise FileNotFoundError(f"there are no feature shards in {path}")
    return [{"file": n} for n in names]


def _widths(store: fs.FileSystem, file: str) -> dict:
    """The shapes of an archive's rows, from the heads of its members."""
    out = {}
    with store.open_input_file(file) as f, zipfile.ZipFile(f) as archive:
        for member in archive.namelist():
            with archive.open(member) as m:
                version = np.lib.format.read_magic(m)
                shape = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(m)[0]
                out[member.removesuffix(".npy")] = list(shape[1:])
    return out


@dataclass
class Shard(InputPartition):
    file: str
    widths: dict


class ShardReader(DataSourceReader):
    def __init__(self, path: str, first: int | None, last: int | None, answers: bool):
        self.path, self.first, self.last, self.answers = path, first, last, answers
        self.some: set[int] | None = None

    def _narrow(self, first=None, last=None):
        self.first = first if self.first is None else self.first if first is None else max(self.first, first)
        self.last = last if self.last is None else self.last if last is None else min(self.last, last)

    def pushFilters(self, filters):
        """Which places are asked for; Spark still applies every filter to the rows of the shards that are left."""
        for f in filters:
            if getattr(f, "attribute", None) == ("seq",) and getattr(f, "value", None) is not None:
                if isinstance(f, EqualTo):
                    self._narrow(f.value, f.value)
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self._narrow(first=f.value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self._narrow(last=f.value - isinstance(f, LessThan))
                elif isinstance(f, In):
                    self.some = set(f.value) if self.some is None else self.some & set(f.value)
            yield f

    def _may_hold(self, shard: dict) -> bool:
        if "first" not in shard:
            return True
        inside = (self.first is None or shard["last"] >= self.first) and (self.last is None or shard["first"] <= self.last)
        return inside and (self.some is None or any(shard["first"] <= p <= shard["last"] for p in self.some))

    def partitions(self):
        shards = _listed(self.path)
        store, folder = _store(self.path)
        if not shards:
            return [Shard("", {})]
        widths = shards[0].get("widths") or _widths(store, f"{folder}/{shards[0]['file']}")
        if self.answers and not {"answers", "margins"} <= set(widths):
            raise ValueError(f"the shards of {self.path} were saved without the answers' parts")
        # one partition at least must be planned, also if no shard can hold what is asked for
        return [Shard(s["file"], widths) for s in shards if self._may_hold(s)] or [Shard("", {})]

    def read(self, partition):
        if not partition.file:
            return
        store, folder = _store(self.path)
        with store.open_input_stream(f"{folder}/{partition.file}") as f:
            held = np.load(io.BytesIO(f.read()), allow_pickle=False)
        arrays = {n: held[n] for n in held.files}
        missing = {"places", "ids", "question", "meaning"} - set(arrays)
        if missing:
            raise ValueError(f"shard {partition.file} has no {', '.join(sorted(missing))}")
        widths = {n: list(a.shape[1:]) for n, a in arrays.items()}
        if widths != partition.widths:
            raise ValueError(f"shard {partition.file} has rows of {widths}, the first shard of {partition.widths}")
        n = len(arrays["places"])
        if any(len(a) != n for a in arrays.values()) or (arrays["ids"] == "").any() or len(np.unique(arrays["places"])) != n:
            raise ValueError(f"shard {partition.file} has not one id and one row of each array for each place")
        asked = np.ones(n, bool)
        if self.first is not None:
            asked &= arrays["places"] >= self.first
        if self.last is not None:
            asked &= arrays["places"] <= self.last
        rows = np.flatnonzero(asked)
        for at in range(0, len(rows), BATCH):
            yield _batch(arrays, rows[at : at + BATCH])


def _lists(a: np.ndarray) -> pa.Array:
    """Rows of a matrix, or of a cube, as lists."""
    flat = pa.array(a.astype(np.float32).ravel())
    for size in a.shape[:0:-1]:
        count = len(flat) // size if size else int(np.prod(a.shape[:-1]))
        flat = pa.ListArray.from_arrays(np.arange(0, (count + 1) * size, size, dtype=np.int32)[: count + 1] if size else np.zeros(count + 1, np.int32), flat)
    return flat


def _batch(arrays: dict, rows: np.ndarray) -> pa.RecordBatch:
    answers = _lists(arrays["answers"][rows]) if "answers" in arrays else pa.nulls(len(rows), pa.list_(pa.list_(pa.float32())))
    margins = _lists(arrays["margins"][rows]) if "margins" in arrays else pa.nulls(len(rows), pa.list_(pa.float32()))
    columns = [pa.array(arrays["places"][rows].astype(np.int64)), pa.array(arrays["ids"][rows].tolist(), pa.string()), _lists(arrays["question"][rows]), _lists(arrays["meaning"][rows]), answers, margins]
    return pa.RecordBatch.from_arrays(columns, ["seq", "id", "question", "meaning", "answers", "margins"])


@dataclass
class Written(WriterCommitMessage):
    shard: dict | None


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        batches = [b for b in iterator if b.num_rows]  # a shard is one file of one partition
        if not batches:
            return Written(None)
        table = pa.Table.from_batches(batches).to_pydict()
        arrays = {"places": np.array(table["seq"], np.int64), "ids": np.array(table["id"], str), "question": np.array(table["question"], np.float32), "meaning": np.array(table["meaning"], np.float32)}
        if any(x is not None for x in table["answers"]):
            arrays |= {"answers": np.array(table["answers"], np.float32), "margins": np.array(table["margins"], np.float32)}
        name, out = f"shard-{uuid.uuid4().hex}.npz", io.BytesIO()
        np.savez(out, **arrays)
        store, folder = _store(self.path)
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/{name}") as f:
            f.write(out.getvalue())
        return Written({"file": name, "rows": len(arrays["places"]), "first": int(arrays["places"].min()), "last": int(arrays["places"].max()), "widths": {n: list(a.shape[1:]) for n, a in arrays.items()}})

    def commit(self, messages):
        new = [m.shard for m in messages if m is not None and m.shard is not None]
        old = _index(self.path) or []
        shards = sorted(new if self.overwrite else [*old, *new], key=lambda s: (s["first"], s["file"]))
        if any(s["widths"] != shards[0]["widths"] for s in shards):
            self.abort(messages)
            raise ValueError(f"the shards of {self.path} would not all have the same columns")
        store, folder = _store(self.path)
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/{INDEX}.new") as f:
            f.write(json.dumps(shards).encode())
        store.move(f"{folder}/{INDEX}.new", f"{folder}/{INDEX}")
        for s in old if self.overwrite else []:
            store.delete_file(f"{folder}/{s['file']}")

    def abort(self, messages):
        store, folder = _store(self.path)
        for m in messages:
            if m is not None and m.shard is not None:
                store.delete_file(f"{folder}/{m.shard['file']}")


class FeatureShards(DataSource):
    @classmethod
    def name(cls):
        return "feature_shards"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        place = lambda n: int(self.options[n]) if n in self.options else None
        return ShardReader(self.options["path"], place("first"), place("last"), self.options.get("answers", "true").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool):
        return ShardWriter(self.options["path"], overwrite)


def register(spark) -> None:
    """Make the format known to a session, with filters pushed down (Spark refuses a source that takes them where they are off)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeatureShards)
