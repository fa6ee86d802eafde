"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

A document leaks an item if some run of its words is within `EDITS` * n word edits of the item's n words (words are runs of
letters, marks and digits of any script, in lower case). Windows of the items' sizes are searched for near items:

1. Exact bounds leave what cannot be near, and lose nothing: an item with at most k edits keeps one of k + 1 pieces whole, so
   only the parts of a text about an exact copy of some piece are looked at (parts for one item that overlap are one part),
   and a part has to have all but k of the item's words.
2. The CGK random walk turns edit into Hamming distance: at each step a random function of step and word says whether to
   move on to the next word. Each of `repeats(n)` independent walks over the part's windows of the item's size is sampled
   at one or two steps; a part with a window that agrees with the item in a walk's sample is a candidate.
3. A candidate is verified exactly, by the least edit distance of the item to any run of words of the part.

Step 2 is the only one that can lose a leak. Walks and samples are chosen for a recall of 0.999 at the limit, whatever the
edits are; deletions, which put the walks out of step for longest, are the worst (README has the recall measured by length).

The items of a block (at most `BLOCK` of them, of about `BLOCK_BYTES`; more are taken block by block) go to every task; documents are read once a
block, row by row, without a shuffle, so hot groups do not meet.

Defined results: null texts and items, and those without a word, leak nothing; rows that repeat an item's key give one leak
(of the nearest text); among runs at one distance the first start, then the first end is given; repeated documents each have theirs; other
columns are carried along. Texts are read whole, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import Words, chunks, grams, mix
from .language_id import lower

EDITS = 0.2
#: Items of a block at most, and bytes of their texts, about.
BLOCK, BLOCK_BYTES = 50_000, 32_000_000

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def split(column: pa.Array) -> Words:
    """The words of each text; only texts beyond ASCII need what is slower."""
    column = column.cast(pa.large_string())
    beyond = pc.invert(pc.fill_null(pc.string_is_ascii(column), True))
    if pc.any(beyond).as_py():
        plain = pc.replace_substring_regex(pc.utf8_lower(column.filter(beyond)), r"[^\pL\pM\pN]+", " ")
        column = pc.replace_with_mask(column, beyond, plain)
    return Words(column, _APART, lower)


def edits(n: int) -> int:
    return int(EDITS * n + 1e-9)


def least_edits(item: np.ndarray, run: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to any part of the run, and that part's start and end (the first such end)."""

    def last_row(a, b):
        row = np.zeros(len(b) + 1, np.int64)
        place = np.arange(len(b) + 1)
        for k, x in enumerate(a, 1):
            best = np.minimum(row[1:] + 1, row[:-1] + (b != x))
            row = np.minimum.accumulate(np.concatenate([[k], best]) - place) + place
        return row

    row = last_row(item, run)
    end = int(row.argmin())
    back = last_row(item[::-1], run[:end][::-1])
    return int(row[end]), end - int(back.argmin()), end


def repeats(n: int) -> tuple[int, int]:
    """Walks, and steps sampled of each, for items of n words: a recall of 0.999 at the limit of edits."""
    if n <= 80:
        return 32 * max(1, -(-n // 20)), 2
    return 64 if n <= 320 else 128, 1


#: Walks at a time: most leaks are found by the first ones.
_TOGETHER = 16


def cgk_samples(words: np.ndarray, first: int) -> np.ndarray:
    """(windows, _TOGETHER) keys of windows of n words (windows, n; 0 where there is no word): what the walks from `first` on see
    at their sampled steps; 0 where a walk is over or sees no word."""
    count, n = words.shape
    walks, sampled = _TOGETHER, repeats(n)[1]
    steps = 2 * n
    chosen = np.argsort(np.random.default_rng((n, first)).random((walks, steps)), axis=1)[:, :sampled]
    padded = np.hstack([words, np.zeros((count, 1), np.uint64)])
    at = np.zeros((count, walks), np.int64)
    keys, seen = np.zeros((count, walks), np.uint64), np.ones((count, walks), bool)
    salt = mix(np.arange(first, first + walks, dtype=np.uint64) + np.uint64(n << 20))
    rows = np.arange(count)[:, None]
    for step in range(int(chosen.max()) + 1):
        now = padded[rows, at]
        hit = (chosen == step).any(1)
        if hit.any():
            keys[:, hit] = mix(keys[:, hit] + now[:, hit] + np.uint64(step + 1))
            seen[:, hit] &= now[:, hit] != 0
        on = (mix(now ^ (salt + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))) >> np.uint64(40)) & np.uint64(1)
        at = np.minimum(at + on.astype(np.int64), n)
    return np.where(seen, mix(keys ^ salt) | np.uint64(1), np.uint64(0))


class Items:
    """The items of a block: words and seeds (first words of every piece)."""

    def __init__(self, names: list[int], texts: list[str]):
        split_items = split(pa.array(texts, pa.large_string()))
        self.names, self.words = [], []
        for k, name in enumerate(names):
            w = split_items.hash[split_items.first[k] : split_items.first[k + 1]]
            if len(w):
                self.names.append(name)
                self.words.append(w)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.limits = np.array([edits(len(w)) for w in self.words], np.int64)
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for item, w in enumerate(self.words):
            k = edits(len(w))
            size = len(w) // (k + 1)
            starts = [len(w) * p // (k + 1) for p in range(k + 1)]
            hashes = grams(w, size)
            for s in starts:
                seeds.setdefault(size, []).append((int(hashes[s]), item, s))
        self.samples: dict[int, list[np.ndarray]] = {}
        self.seeds = {}
        for size, found in seeds.items():
            found.sort()
            self.seeds[size] = tuple(np.array(x, t) for x, t in zip(zip(*found, strict=True), (np.uint64, np.int64, np.int64), strict=True))

    def near(self, item: int, part: np.ndarray) -> bool:
        """Whether some window of the part (which may hang over its ends) shares a sample of a walk with the item."""
        w, k = self.words[item], int(self.limits[item])
        n = len(w)
        walks = range(0, repeats(n)[0], _TOGETHER)
        if item not in self.samples:
            self.samples[item] = [cgk_samples(w[None, :], first) for first in walks]
        body = np.concatenate([np.zeros(k, np.uint64), part, np.zeros(n, np.uint64)])
        windows = np.lib.stride_tricks.sliding_window_view(body, n)[: k + len(part)]
        for first, own in zip(walks, self.samples[item], strict=True):
            for at in range(0, len(windows), 1024):
                if ((cgk_samples(windows[at : at + 1024], first) == own) & (own != 0)).any():
                    return True
        return False

    def parts(self, words: Words) -> np.ndarray:
        """Rows of text number, item, start and end (in words) of the parts of texts about a seed of the item."""
        found = [np.zeros((0, 3), np.int64)]
        text = words.text_of()
        for size, (hashes, item, offset) in self.seeds.items():
            g, whole = words.grams(size)
            low = np.searchsorted(hashes, g)
            hit = np.flatnonzero(whole & (hashes[np.minimum(low, len(hashes) - 1)] == g))
            if not len(hit):
                continue
            count = np.searchsorted(hashes, g[hit], "right") - low[hit]
            where = np.repeat(hit, count)
            entry = np.repeat(low[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())
            # an item may hang over either end of the text
            found.append(np.stack([text[where], item[entry], where - words.first[text[where]] - offset[entry]], 1))
        rows = np.unique(np.concatenate(found), axis=0)
        if not len(rows):
            return np.zeros((0, 4), np.int64)
        n, k = self.sizes[rows[:, 1]], self.limits[rows[:, 1]]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1) | (rows[1:, 2] - rows[:-1, 2] > n[1:] + 2 * k[1:])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(rows)) - 1
        start = np.maximum(rows[first, 2] - k[first], 0)
        end = np.minimum(rows[last, 2] + n[last] + k[last], words.count[rows[first, 0]])
        return np.stack([rows[first, 0], rows[first, 1], start, end], 1)

    def leaks(self, words: Words) -> dict[int, dict[int, tuple[int, int, int]]]:
        """For each text its items: edit distance, start and end (in words)."""
        found: dict[int, dict[int, tuple[int, int, int]]] = {}
        for text, item, a, b in self.parts(words).tolist():
            w, k, name = self.words[item], int(self.limits[item]), self.names[item]
            part = words.hash[words.first[text] + a : words.first[text] + b]
            if np.isin(w, part).sum() < len(w) - k or not self.near(item, part):
                continue
            d, start, end = least_edits(w, part)
            best = found.get(text, {}).get(name)
            if d <= k and (best is None or (d, a + start) < best[:2]):
                found.setdefault(text, {})[name] = (d, a + start, a + end)
        return found


LEAKS = ArrayType(StructType([StructField(n, LongType()) for n in ("item_id", "distance", "start", "end")]))
_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "distance", "start", "end")]))


def _with_leaks(docs: DataFrame, items: Items, text: str, column: str, keep_text: bool) -> DataFrame:
    kept = [f for f in docs.schema.fields if (keep_text or f.name != text) and f.name != column]
    before = column in docs.columns
    schema = StructType([*kept, StructField(column, LEAKS)])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                found = items.leaks(split(part.column(text)))
                old = part.column(column).to_pylist() if before else [[]] * part.num_rows
                rows = [old[k] + [{"item_id": i, "distance": d, "start": a, "end": b} for i, (d, a, b) in sorted(found.get(k, {}).items())] for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(rows, _ARROW)], [*(f.name for f in kept), column])

    return docs.mapInArrow(run, schema)


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", column: str = "leaks", keep_text: bool = True) -> DataFrame:
    """Add the array of leaks (item_id, distance, start, end) to every document."""
    docs = docs.drop(column)  # a caller's column of that name gives way
    benchmark = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull() & F.col("item").isNotNull())
    count, size = benchmark.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-count // BLOCK), -(-(size or 0) // BLOCK_BYTES))
    for block in range(blocks):
        rows = benchmark.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect() if blocks > 1 else benchmark.collect()
        docs = _with_leaks(docs, Items([r.item for r in rows], [r.text for r in rows]), text, column, keep_text or block < blocks - 1)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    """Leaks of all items in all documents. Exact pieces propose the parts of a text, the walks' samples say which of them are verified: the
    embedding thins what the pieces leave, as walking every window of every item's size costs more than the documents' words allow."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.distance", "x.start", "x.end")
