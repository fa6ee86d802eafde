"""Substring dedup by compressed FM-indexes of shards.

A window is `WINDOW` consecutive words of one document; a window whose words also start anywhere else (same document
included) is a repeat, and every word that a repeat covers is removed. Windows are judged on the input.

1. Each window has an anchor, the least hash of its runs of `ANCHOR` words, so equal windows have equal anchors. Anchors
   (about one in fourteen words) are counted; only windows whose anchor occurs in two texts, or twice in one, go on.
2. Consecutive windows with one anchor make a fragment. Fragments are dealt to shards by anchor, so all equal windows meet in
   one shard. Equal fragments are streamed once, and are in the index twice.
3. An anchor whose distinct fragments have over `HOT` words (a passage that very many documents share, in different
   surroundings) is cut anew by a longer anchor: the anchor grows by half of its window's other words, on the side that has
   more of them, which the window alone decides. Longer anchors that occur once end there; what is still hot grows again
   (8, 22, 29, 32, 34, 35 words), until the anchor is the window and only equal windows share it.
4. Each shard, of about `SHARD` words, builds an FM-index (BWT in a wavelet matrix) of its distinct fragments and streams all
   of them through it by backward search; the matching statistics, kept up to the window's length, say which windows occur
   twice or more. They alone decide, for hot anchors too.

Exact copies of a text are one text from the start; a text that occurs twice is one repeat if it has a window at all. No
step brings a hot group together: counts are combined before shuffles, and joins are between written tables, whose hot
partitions are split at run time.

Defined results: null texts, and texts shorter than a window, lose nothing (kept_sha256 is that of an empty string for a text
without words); null keys and repeated rows are kept (repeated rows are copies of each other); other columns are ignored.
Words are compared by 64-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, forget, grams, mix, table
from .fm_index import Index

WINDOW, ANCHOR = 35, 8
#: Windows of a fragment at most; words of a shard, about, and of the distinct fragments of one anchor in a shard.
LONGEST, SHARD, HOT = 128, 150_000, 50_000
#: Times that an anchor grows until it is the window.
LEVELS = 5
_SPAN = WINDOW - ANCHOR + 1
EMPTY = hashlib.sha256(b"").hexdigest()


def _slide(values: np.ndarray, n: int, combine) -> np.ndarray:
    """combine over values[i : i + n], for each i (fewer at the end)."""
    out, size = values.copy(), 1
    while size < n:
        by = min(size, n - size)
        out[: len(out) - by] = combine(out[: len(out) - by], out[by:])
        size += by
    return out


class Anchors:
    """Anchors of the windows of all texts: value of each window (by its first word), and which places are anchors."""

    def __init__(self, words: Words):
        self.words = words
        g = mix(grams(words.hash, ANCHOR) | np.uint64(1)) | np.uint64(1)
        self.valid = words.whole(WINDOW)
        self.value = np.where(self.valid, _slide(g, _SPAN, np.minimum), np.uint64(0)) if len(g) else g
        most = _slide(self.value, _SPAN, np.maximum)
        around = np.concatenate([np.maximum.accumulate(self.value[: _SPAN - 1]), most[: max(0, len(g) - _SPAN + 1)]])[: len(g)]
        at = np.flatnonzero(around == g)
        text = words.text_of()[at]
        order = np.lexsort((g[at], text))
        self.text, self.anchor = text[order], g[at][order]


def profile(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row per document: key, name, text_key, words, sha of all words, anchors, and those that come twice in the text."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                words = Words(part.column(text))
                a = Anchors(words)
                new = np.ones(len(a.text), bool)
                new[1:] = (a.text[1:] != a.text[:-1]) | (a.anchor[1:] != a.anchor[:-1])
                first = np.flatnonzero(new)
                twice = np.diff(np.append(first, len(a.text))) > 1
                bounds = np.arange(part.num_rows + 1)
                lists = []
                for pick in (first, first[twice]):
                    lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(a.text[pick], bounds).astype(np.int32)), pa.array(a.anchor[pick].view(np.int64))))
                raw = words.data.tobytes()
                shas = [hashlib.sha256(b" ".join(raw[i:j].split())).hexdigest() for i, j in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_name"), part.column("_text"), pa.array(words.count.astype(np.int64)), pa.array(shas), *lists], ["id", "name", "text_key", "n_words", "sha", "anchors", "twice"])

    source = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_name"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("_text"), text)
    kind = dict(docs.dtypes)[key]
    return source.mapInArrow(run, f"id {kind}, name string, text_key binary, n_words long, sha string, anchors array<long>, twice array<long>")


def fragments(texts: DataFrame, text: str) -> DataFrame:
    """(route, text_key, start, windows, body) of every fragment of the texts whose anchor is among the column `wanted`."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                words = Words(part.column(text))
                value, valid = Anchors(words).value, words.whole(WINDOW)
                number = words.text_of()
                wanted = part.column("wanted")
                known = mix(wanted.values.to_numpy(zero_copy_only=False)[wanted.offsets[0].as_py() : wanted.offsets[-1].as_py()].view(np.uint64) + np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy())).astype(np.uint64))
                use = np.zeros(len(value), bool)
                use[valid] = np.isin(mix(value[valid] + number[valid].astype(np.uint64)), known)
                new = use.copy()
                new[1:] &= ~use[:-1] | (value[1:] != value[:-1]) | (number[1:] != number[:-1])
                head = np.flatnonzero(new)
                if not len(head):
                    continue
                run_of = np.cumsum(new)[use] - 1
                size = np.bincount(run_of, minlength=len(head))
                # long runs are cut
                pieces = -(-size // LONGEST)
                head = np.repeat(head, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LONGEST
                size = np.minimum(LONGEST, np.repeat(np.repeat(0, len(size)) + size, pieces) - (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LONGEST)
                raw = words.data.tobytes()
                bodies = [b" ".join(raw[i:j].split()) for i, j in zip(words.start[head], words.end[head + size + WINDOW - 2], strict=True)]
                t = number[head]
                yield pa.RecordBatch.from_arrays([pa.array(value[head].view(np.int64)), part.column("text_key").take(pa.array(t)), pa.array((head - words.first[t]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(bodies, pa.binary())], ["route", "text_key", "start", "windows", "body"])

    return texts.select("text_key", text, "wanted").mapInArrow(run, "route long, text_key binary, start int, windows int, body binary")


def _longer(words: Words, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window (by its first word) the start of its anchor at the level, and the anchor's hash."""
    g = mix(grams(words.hash, ANCHOR) | np.uint64(1)) | np.uint64(1)
    n = len(g)
    window = np.arange(n)
    least, start = _slide(g, _SPAN, np.minimum), np.arange(n)
    for k in range(_SPAN - 1, -1, -1):
        here = np.minimum(window + k, n - 1)
        start = np.where(g[here] == least, here, start)
    size = ANCHOR
    for _ in range(level):
        by = -(-(WINDOW - size) // 2)
        left = start - window
        start = start - np.where(left >= WINDOW - size - left, by, 0)
        size += by
    start = np.clip(start, 0, n - 1)
    return start, (grams(words.hash, size) + np.uint64(size))[start]


def recut(pieces: DataFrame, level: int) -> DataFrame:
    """(route, windows, body, number, source, shift): the pieces cut and routed anew by the anchors of a level."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "body", 500_000):
                words = Words(part.column("body").cast(pa.string()))
                start, route = _longer(words, level)
                number = words.text_of()
                at = np.flatnonzero(words.whole(WINDOW))
                new = np.ones(len(at), bool)
                new[1:] = (start[at][1:] != start[at][:-1]) | (number[at][1:] != number[at][:-1])
                head = at[new]
                size = np.diff(np.append(np.flatnonzero(new), len(at)))
                raw = words.data.tobytes()
                bodies = [raw[i:j] for i, j in zip(words.start[head], words.end[head + size + WINDOW - 2], strict=True)]
                row = number[head]
                take = pa.array(row)
                shift = part.column("shift").to_numpy()[row] + head - words.first[row]
                yield pa.RecordBatch.from_arrays([pa.array(route[head].view(np.int64)), pa.array(size.astype(np.int32)), pa.array(bodies, pa.binary()), part.column("number").take(take), part.column("source").take(take), pa.array(shift.astype(np.int32))], ["route", "windows", "body", "number", "source", "shift"])

    return pieces.select("body", "number", "source", "shift").mapInArrow(run, "route long, windows int, body binary, number long, source binary, shift int")


def shard_repeats(bodies: pa.Array, number: np.ndarray) -> list[bytes]:
    """For each distinct fragment of a shard, a byte for each of its windows: 1 if it occurs twice or more.

    Fragments that come more than once are in the index twice.
    """
    n = len(bodies)
    words = Words(pa.concat_arrays([bodies, bodies.filter(pa.array(number > 1))]))
    index = Index(words.hash, words.first[1:], WINDOW)
    start = index.place[words.first[:n]]
    count = index.matches(start, start + words.count[:n])
    repeat = (count > 1).astype(np.uint8)
    return [repeat[s : s + k - WINDOW + 1].tobytes() for s, k in zip(start, words.count[:n], strict=True)]


def repeats(distinct: DataFrame, shards: int) -> DataFrame:
    """(fragment, repeat) of the distinct fragments with some repeat: which of its windows are."""

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        found = shard_repeats(shard.column("body").combine_chunks().cast(pa.string()), shard.column("number").to_numpy()) if shard.num_rows else []
        keep = pa.array([b"\x01" in x for x in found], pa.bool_())
        return pa.table({"fragment": shard.column("fragment").filter(keep), "repeat": pa.array(found, pa.binary()).filter(keep)})

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards))).select("shard", "fragment", "body", "number")
    return dealt.groupBy("shard").applyInArrow(run, "fragment binary, repeat binary")


def digest():
    """Names a fragment by its route and words."""
    return F.unhex(F.md5(F.concat(F.col("route").cast("string").cast("binary"), F.lit("|").cast("binary"), F.col("body"))))


def marked(pieces: DataFrame, level: int = 0) -> DataFrame:
    """(source, shift, repeat): for the pieces with repeats, where they are in their first fragment and which windows are.

    pieces: (route, windows, body, number, source, shift), where number says how often the source occurs.
    """
    pieces = table(pieces.withColumn("fragment", digest()), "sub-pieces")
    distinct = pieces
    if level:
        distinct = table(pieces.groupBy("route", "fragment", "body", "windows").agg(F.sum("number").alias("number")), "sub-distinct")
    size = F.sum(F.col("windows") + WINDOW - 1)
    sizes = distinct.groupBy("route").agg(size.alias("n"))
    hot = table(sizes.filter((F.col("n") > HOT) & F.lit(level < LEVELS)).select("route"), "sub-hot")
    cold = distinct.join(hot, "route", "left_anti")
    words = cold.agg(size).first()[0] or 0
    found = table(repeats(cold, max(1, -(-words // SHARD))), "sub-repeats")
    if level:
        marks = table(pieces.select("fragment", "source", "shift").join(found, "fragment").select("source", "shift", "repeat"), "sub-marks")
        forget(found, distinct)
    else:
        marks = found.select(F.col("fragment").alias("source"), F.lit(0).alias("shift"), "repeat")
    if hot.isEmpty():
        forget(pieces, hot)
        return marks
    again = table(recut(pieces.join(hot, "route"), level + 1), "sub-recut")
    forget(pieces, hot)
    # an anchor that occurs once, in a fragment that does, holds no repeat
    twice = table(again.groupBy("route").agg(F.sum("number").alias("n")).filter(F.col("n") > 1).select("route"), "sub-anchors")
    return marks.union(marked(again.join(twice, "route"), level + 1))


def removed_rows(texts: DataFrame, text: str) -> DataFrame:
    """(text_key, n_removed, kept_sha256, kept spans) of texts with the column `hits` of (start, repeat)."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                words = Words(part.column(text))
                raw = words.data.tobytes()
                gone, shas, spans = [], [], []
                for k, hits in enumerate(part.column("hits").to_pylist()):
                    n, first = int(words.count[k]), int(words.first[k])
                    edge = np.zeros(n + 1, np.int64)
                    for hit in hits:
                        at = np.flatnonzero(np.frombuffer(hit["repeat"], np.uint8)) + hit["start"]
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + WINDOW, -1)
                    keep = np.cumsum(edge)[:n] == 0
                    flips = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
                    kept = [b" ".join(raw[words.start[first + a] : words.end[first + b - 1]].split()) for a, b in zip(flips[::2], flips[1::2], strict=True)]
                    gone.append(n - int(keep.sum()))
                    shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(flips[::2], flips[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("text_key"), pa.array(gone, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["text_key", "n_removed", "kept_sha256", "kept"])

    return texts.select("text_key", text, "hits").mapInArrow(run, "text_key binary, n_removed long, kept_sha256 string, kept array<struct<start:int,end:int>>")


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, n_removed, kept_sha256, and kept, the spans of words that stay (null: all)."""
    rows = table(profile(docs, key, text), "sub-profile")
    seen = rows.select(F.col("text_key"), F.explode("anchors").alias("anchor"), F.xxhash64("text_key").alias("x"))
    twice = rows.select(F.explode("twice").alias("anchor"), (F.xxhash64("text_key").bitwiseXOR(F.lit(1))).alias("x"))
    often = seen.select("anchor", "x").union(twice).groupBy("anchor").agg(F.min("x").alias("low"), F.max("x").alias("high")).filter(F.col("low") != F.col("high")).select("anchor")
    often = table(often, "sub-anchors")
    wanted = seen.select("anchor", "text_key").join(often, "anchor").groupBy("text_key").agg(F.collect_set("anchor").alias("wanted"))
    names = rows.groupBy("text_key", "name").agg(F.count("*").alias("rows"))
    texts = table(names.groupBy("text_key").agg(F.min("name").alias("name"), F.min_by("rows", "name").alias("rows"), F.sum("rows").alias("copies")), "sub-texts")
    wanted = table(wanted.join(texts, "text_key").select("text_key", "name", "wanted", "rows"), "sub-wanted")
    forget(often)
    named = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("text_key"), text)

    def candidates(which):
        return named.join(wanted.filter(which).drop("rows").hint("shuffle_hash"), ["text_key", "name"]).select("text_key", text, "wanted")

    some = candidates("rows = 1")
    # rows equal in key and text: one stands for them
    if not wanted.filter("rows > 1").isEmpty():
        some = some.union(candidates("rows > 1").dropDuplicates(["text_key"]))
    some = table(some, "sub-candidates")
    forget(wanted)
    found = table(fragments(some, text).withColumn("source", digest()), "sub-fragments")
    first = found.groupBy("route", "source", "body", "windows").agg(F.count("*").alias("number")).withColumn("shift", F.lit(0))
    marks = marked(first.select("route", "windows", "body", "number", "source", "shift"))
    hits = found.select("source", "text_key", "start").join(marks, "source")
    hits = hits.groupBy("text_key").agg(F.collect_list(F.struct((F.col("start") + F.col("shift")).alias("start"), "repeat")).alias("hits"))
    hits = table(hits, "sub-hits")
    cut = table(removed_rows(some.drop("wanted").join(hits.hint("shuffle_hash"), "text_key"), text), "sub-removed")
    forget(found, some, hits)
    # a text that occurs twice is removed whole; of one that occurs once, what the index found
    result = texts.select("text_key", "copies").join(cut, "text_key", "left")
    result = table(result.filter((F.col("copies") > 1) | F.col("kept_sha256").isNotNull()), "sub-result")
    forget(cut, texts)
    out = rows.select("id", "text_key", "n_words", "sha").join(result, "text_key", "left")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select(
        F.col("id").alias(key),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, none).otherwise(F.col("kept")).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT r, i, md5(array_to_string(ws[i:i+34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
again AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
cov AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN again USING (h)),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM w ANTI JOIN cov USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
