"""MinHash near-dedup by ProbMinHash.

Shingles of `WORDS` words, weighted by how often they come, are elements of a weighted set. Every element is the source of a
Poisson process whose rate is its weight; each arrival falls in one of `M` registers at random, and a register keeps the
element that arrives first. A process ends early once its next arrival is later than every register's. Two sets agree in a
register with their probability Jaccard similarity, or, if all weights are taken as 1, with their plain Jaccard. Bands of
`ROWS` registers are the keys of candidate buckets; a text with repeated shingles has those of its counts and those of
weights 1, other texts have one and the same for both. Candidates are verified exactly: linked at a probability Jaccard,
or a plain Jaccard of the shingle sets, of 0.8 or more.

Exact copies are one text from the start (by md5), so groups of copies are never expanded. In a bucket each text is compared
with the bucket's leader, the text with the most company in all its buckets (the middle of a group of near copies), which
is linear in the bucket. A second pass is for buckets that are still of several components: texts outside the largest one
are compared with the bucket's texts in other components, except where a bound shows that they cannot be linked. A text
whose shingles are over a fifth its own (no other such text has them), by number and by count, is like none; a pair's similarity is bounded by its
sizes and shared shingles, so texts without repeated shingles meet only where their sizes (in steps of `WIDTH`) allow a link: many
texts of a size that share too little with all others make no pairs; pairs whose shingles differ too much are left out, by a bitmap
of what each has other than the bucket's leader (see `differences`); and so are pairs that agree in too few registers, by counts and by weights 1. A pair at
similarity 0.8 of either kind shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, 2e-5 here.

Result: one row per document with class_id, the least key of its class (a connected component of links). Defined results:
null texts and texts without a word are each their own class (class_id is the row's key); a text of fewer words than a
shingle is one shingle; a null key counts as larger than all; repeated rows share a class; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, grams, mix, table
from .components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
M = BANDS * ROWS
#: Registers of the second pass, and in how many a pair has to agree to be compared: one at 0.8 falls short with probability 1e-5.
FINE, NEAR = 256, 176
#: Ratio of the sizes that meet in the second pass.
WIDTH = 1.1
#: Bits of the bitmap of a text's differences from its bucket's leader.
BITS = 2048
SIGNS = ["buckets", "registers", "plain_buckets", "plain_registers"]


def shingles(words: Words, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of every distinct shingle, by text and hash."""
    text, hashes, whole = words.text_of(), grams(words.hash, n), words.whole(n)
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    t, h = text[whole], hashes[whole]
    if len(short):
        t = np.concatenate([t, short])
        h = np.concatenate([h, [grams(words.hash[words.first[k] : words.first[k + 1]], n)[0] for k in short]]).astype(np.uint64)
    order = np.lexsort((h, t))
    t, h = t[order], h[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return t[at], h[at], np.diff(np.append(at, len(t)))


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, m: int = M) -> np.ndarray:
    """(texts, m): the element that arrives first in each register (0 where a text has no element)."""
    first = np.full(texts * m, np.inf)
    who = np.zeros(texts * m, np.uint64)
    now, latest = np.zeros(len(element)), np.full(texts, np.inf)
    step = 0
    while len(element):
        step += 1
        u = mix(element + np.uint64(step * 0xD1B54A32D192ED03 % (1 << 64)))
        now = now - np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        on = now < latest[text]
        text, element, weight, now, u = text[on], element[on], weight[on], now[on], u[on]
        register = text * m + (mix(u) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, register, now)
        won = first[register] == now
        who[register[won]] = element[won]
        latest = first.reshape(texts, m).max(1)
    return who.reshape(texts, m)


def band_keys(who: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit keys of signatures; never 0."""
    who = who.reshape(len(who), BANDS, ROWS)
    key = np.zeros((len(who), BANDS), np.uint64)
    for r in range(ROWS):
        key = mix(key + who[:, :, r] * np.uint64(2 * r + 3))
    return mix(key + np.arange(BANDS, dtype=np.uint64)) | np.uint64(1)


def ones_too(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures by weight, numbers of the texts whose weights are not all 1, and the signatures of those by weights 1."""
    uneven = np.unique(text[weight != 1])
    of = np.isin(text, uneven)
    plain = signatures(np.searchsorted(uneven, text[of]), element[of], np.ones(int(of.sum())), len(uneven), m)
    return signatures(text, element, weight.astype(float), texts, m), uneven, plain


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The greater of probability Jaccard and plain Jaccard of two weighted sets (sorted elements, weights)."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    union = len(a) + len(b) - len(i)
    if not len(i):
        return 0.0
    plain = len(i) / union
    if wa.max() == wb.max() == 1:
        return plain
    v, w = wa[i].astype(float), wb[j].astype(float)
    order = np.argsort(w / v, kind="stable")
    v, w = v[order], w[order]
    only_a, only_b = wa.sum() - v.sum(), wb.sum() - w.sum()
    below = np.cumsum(v) + only_a  # elements whose ratio is no greater: theirs counts by v
    above = w.sum() - np.cumsum(w) + only_b
    return max(plain, float((1 / (below / v + above / w)).sum()))


def bands(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, key): a row for each band of each text with a word, also by weights 1 if some shingle repeats."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                words = Words(part.column(text))
                t, h, c = shingles(words)
                some = np.flatnonzero(words.count > 0)
                weighted, uneven, plain = ones_too(t, h, c, part.num_rows)
                keys = np.concatenate([band_keys(weighted)[some], band_keys(plain)])
                names = np.repeat(np.concatenate([some, uneven]), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), part.column(key).take(pa.array(names))], ["bucket", "key"])

    return texts.select(key, text).mapInArrow(run, "bucket long, key binary")


def weighted_sets(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, elements, weights): the sorted shingle hashes of each text and their counts, packed; no weights if all are 1."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                t, h, c = shingles(Words(part.column(text)))
                ends = np.searchsorted(t, np.arange(part.num_rows + 1))
                elements = [h[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                weights = [b"" if (c[a:b] == 1).all() else c[a:b].astype(np.uint32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(elements, pa.binary()), pa.array(weights, pa.binary())], ["key", "elements", "weights"])

    return texts.select(key, text).mapInArrow(run, "key binary, elements binary, weights binary")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least so similar."""
    left = sets.select(F.col("key").alias("a"), F.col("elements").alias("ea"), F.col("weights").alias("wa"))
    right = sets.select(F.col("key").alias("b"), F.col("elements").alias("eb"), F.col("weights").alias("wb"))
    # b differs from row to row, a (the leader) may be hot: its set comes last and is split at run time
    both = pairs.join(right, "b").join(left, "a")

    def unpack(e, w):
        e = np.frombuffer(e, np.uint64)
        return e, np.frombuffer(w, np.uint32) if w else np.ones(len(e), np.uint32)

    def run(batches):
        for batch in batches:
            good = [similarity(*unpack(ea.as_buffer(), wa.as_py()), *unpack(eb.as_buffer(), wb.as_py())) >= least for ea, wa, eb, wb in zip(*(batch.column(n) for n in ("ea", "wa", "eb", "wb")), strict=True)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return both.select("a", "b", "ea", "wa", "eb", "wb").mapInArrow(run, "a binary, b binary")


def _unpacked(part: pa.RecordBatch):
    """Row numbers, elements and weights of packed sets."""
    e = [np.frombuffer(x, np.uint64) for x in part.column("elements").to_pylist()]
    w = [np.frombuffer(x, np.uint32) if x else np.ones(len(y), np.uint32) for x, y in zip(part.column("weights").to_pylist(), e, strict=True)]
    return np.repeat(np.arange(len(e)), [len(x) for x in e]), np.concatenate(e), np.concatenate(w)


def shares(sets: DataFrame) -> DataFrame:
    """(id, size, shared, even, weight_share) of every set: shingles, those that another of the sets has too, whether all come
    once, and the share of shared ones by count.

    A text is like another at most by its share of shared shingles: plain Jaccard by number, probability Jaccard by count.
    The sets come with an id each.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows, e, w = _unpacked(part)
                total = np.bincount(rows, w, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), pa.array(e.view(np.int64)), pa.array(w / total[rows])], ["id", "element", "part"])

    flat = sets.select("id", "elements", "weights").mapInArrow(run, "id long, element long, part double")
    alone = flat.groupBy("element").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("part").alias("part")).filter(F.col("n") == 1).groupBy("id").agg(F.count("*").alias("alone"), F.sum("part").alias("alone_part"))
    total = sets.select("id", (F.octet_length("elements") / 8).cast("long").alias("size"), (F.octet_length("weights") == 0).alias("even"))
    return total.join(alone, "id", "left").select("id", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"), "even", (1 - F.coalesce("alone_part", F.lit(0.0))).alias("weight_share"))


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(leader, key, total, off, bits) of pairs (leader, key): the text's shingles by count, how far its counts are off the leader's (off
    1, where the leader has none), and a bitmap of the shingles that one of both has and the other has not.

    What two texts x and y differ in is what their differences from a third one differ in, and each bit in which their bitmaps
    differ stands for at least one shingle of those. At a plain Jaccard of t they differ in (1 - t) / (1 + t) of |x| + |y| at most. At
    a probability Jaccard of t, with counts x_i and y_i and U the sum of the greater ones, the part of a shared shingle is at most
    max(x_i, y_i) / U; so the others weigh (1 - t) / (1 + t) of both totals and of what the counts of shared ones differ by, at most,
    which is not over what both are off. So `too_far` leaves out no link, whatever the bits are.
    """
    left = sets.select(F.col("key").alias("leader"), F.col("elements").alias("el"), F.col("weights").alias("wl"))
    # as in `verified`, the leader may be hot
    both = pairs.join(sets.select("key", F.col("elements").alias("ek"), F.col("weights").alias("wk")), "key").join(left, "leader")

    def unpack(e, w):
        e = np.frombuffer(e, np.uint64)
        return e, np.frombuffer(w, np.uint32).astype(np.int64) if w else np.ones(len(e), np.int64)

    def run(batches):
        for batch in batches:
            bits, total, off = np.zeros((batch.num_rows, BITS // 64), np.uint64), [], []
            for k, (ek, wk, el, wl) in enumerate(zip(*(batch.column(n) for n in ("ek", "wk", "el", "wl")), strict=True)):
                (own, x), (others, y) = unpack(ek.as_buffer(), wk.as_py()), unpack(el.as_buffer(), wl.as_py())
                _, i, j = np.intersect1d(own, others, assume_unique=True, return_indices=True)
                place = np.concatenate([np.delete(own, i), np.delete(others, j)]) % np.uint64(BITS)
                np.bitwise_or.at(bits[k], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
                likely = np.ones(len(own), np.int64)
                likely[i] = y[j]
                total.append(int(x.sum()))
                off.append(int(np.abs(x - likely).sum()))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(bits.view(np.int64).ravel()), BITS // 64).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("key"), pa.array(total, pa.int64()), pa.array(off, pa.int64()), lists], ["leader", "key", "total", "off", "bits"])

    return both.select("leader", "key", "ek", "wk", "el", "wl").mapInArrow(run, "leader binary, key binary, total long, off long, bits array<long>")


def too_far(x: str, y: str, least: float):
    """Whether the bitmaps of two texts of a bucket (columns that end in x and y) show that they are not linked."""
    apart = sum((F.bit_count(F.get(f"bits_{x}", F.lit(k)).bitwiseXOR(F.get(f"bits_{y}", F.lit(k)))) for k in range(BITS // 64)), F.lit(0))
    most = sum((F.col(f"{c}_{side}") for c in ("total", "off") for side in (x, y)), F.lit(0))
    return apart > most * ((1 - least) / (1 + least)) + 1e-6


def signed(sets: DataFrame) -> DataFrame:
    """(key, buckets, registers, plain_buckets, plain_registers) of sets: the band keys, and 16 bits of each of FINE registers.

    The plain ones are by weights 1, null where all weights are 1.
    """

    def packed(keys, fine, rows, n):
        fine = (mix(fine) >> np.uint64(48)).astype(np.uint16).view(np.int16)
        at = np.full(n, -1)
        at[rows] = np.arange(len(rows))
        where = pa.array(at, mask=at < 0)
        return [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(kind)).take(where) for x, kind in ((keys.view(np.int64), pa.int64()), (fine, pa.int16()))]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows, e, w = _unpacked(part)
                n = part.num_rows
                weighted, uneven, plain = ones_too(rows, e, w, n)
                fine, _, plain_fine = ones_too(rows, mix(e), w, n, FINE)
                lists = packed(band_keys(weighted), fine, np.arange(n), n) + packed(band_keys(plain), plain_fine, uneven, n)
                yield pa.RecordBatch.from_arrays([part.column("key"), *lists], ["key", *SIGNS])

    return sets.select("key", "elements", "weights").mapInArrow(run, "key binary, buckets array<long>, registers array<smallint>, plain_buckets array<long>, plain_registers array<smallint>")


def links(texts: DataFrame, key: str, text: str, name: str, least: float = SIMILARITY) -> DataFrame:
    """(node, root) of every distinct text that is linked with another one. `name` and key tell one row of each text."""
    every = table(bands(texts, key, text).distinct(), "near-bands")
    crowded = table(every.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > 1), "near-buckets")
    shared = table(every.join(crowded, "bucket"), "near-shared")
    # the leader of a bucket is its text with the most company in all its buckets: the middle of a group
    company = table(shared.groupBy("key").agg(F.sum("n").alias("company")), "near-company")
    ranked = shared.join(company, "key")
    leaders = ranked.groupBy("bucket").agg(F.max_by("key", F.struct("company", "key")).alias("leader"))
    shared = table(shared.drop("n").join(table(leaders, "near-leaders"), "bucket"), "near-led")
    pairs = table(shared.filter(F.col("key") != F.col("leader")).select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct(), "near-pairs")
    # one row of every text that is in some pair
    one = texts.groupBy(key, name).agg(F.count("*").alias("rows")).groupBy(key).agg(F.min_by("rows", name).alias("rows"), F.min(name).alias(name))
    wanted = table(one.join(company.select(F.col("key").alias(key)), key), "near-wanted")

    def bodies(which):
        return texts.join(wanted.filter(which).drop("rows").hint("shuffle_hash"), [key, name]).select(key, text)

    some = bodies("rows = 1")
    # rows equal in key and text: one stands for them
    if not wanted.filter("rows > 1").isEmpty():
        some = some.union(bodies("rows > 1").dropDuplicates([key]))
    sets = table(weighted_sets(some, key, text), "near-sets")
    found = table(verified(pairs, sets, least), "near-links")
    roots = components(found)
    # texts of a bucket outside the component that has most of it
    placed = table(shared.select("bucket", "leader", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "near-placed")
    heads = placed.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("head")).filter(F.col("roots") > 1)
    split = table(placed.join(table(heads.select("bucket", "head"), "near-heads"), "bucket"), "near-split")
    if split.isEmpty():
        return roots
    # numbers of texts are written, so that all that follows sees the same ones
    opened = table(sets.join(split.select("key").distinct(), "key").withColumn("id", F.monotonically_increasing_id()), "near-open")
    # parts are added in any order, so the bound by count has a margin
    able = (F.col("shared") >= least * F.col("size")) | (F.col("weight_share") >= least - 1e-9)
    bound = table(shares(opened).filter(able).drop("weight_share"), "near-bounds")
    kept = opened.join(bound, "id").drop("id")
    signs = table(kept.select("key", "size", "shared", "even").join(signed(kept).dropDuplicates(["key"]), "key"), "near-signs")
    split = table(split.join(signs.select("key"), "key"), "near-able")
    apart = table(differences(split.select("leader", "key").distinct(), sets), "near-apart")
    split = table(split.join(apart, ["leader", "key"]).join(signs, "key"), "near-candidates")
    names = ("key", "root", "size", "shared", "even", "total", "off", "bits", *SIGNS)
    x = split.filter(F.col("root") != F.col("head")).select("bucket", *[F.col(c).alias(f"{c}_x") for c in names])
    y = split.select("bucket", "head", *[F.col(c).alias(f"{c}_y") for c in names])
    most = F.least("shared_x", "shared_y")
    sized = ~F.col("even_x") | ~F.col("even_y") | (most >= least * (F.col("size_x") + F.col("size_y") - most))
    once = (F.col("root_y") == F.col("head")) | (F.col("key_x") < F.col("key_y"))

    def plain(name, side):
        return F.coalesce(f"plain_{name}_{side}", f"{name}_{side}")

    def shared_buckets(p, q):
        return F.filter(F.zip_with(p, q, lambda v, w: F.when(v == w, v)), lambda v: v.isNotNull())

    def near(p, q):
        return F.aggregate(F.zip_with(p, q, lambda v, w: F.when(v == w, 1).otherwise(0)), F.lit(0), lambda s, v: s + v) >= NEAR

    # a pair is looked at in the first bucket that it shares by counts, or else by weights 1
    first = F.coalesce(F.get(shared_buckets(F.col("buckets_x"), F.col("buckets_y")), F.lit(0)), F.get(shared_buckets(plain("buckets", "x"), plain("buckets", "y")), F.lit(0))) == F.col("bucket")
    uneven = F.col("plain_registers_x").isNotNull() | F.col("plain_registers_y").isNotNull()
    agree = near(F.col("registers_x"), F.col("registers_y")) | (uneven & near(plain("registers", "x"), plain("registers", "y")))
    # even texts meet by size: of a text whose shared shingles are few, only the sizes that it can be linked with; where shingles
    # repeat, sizes say nothing
    step = lambda c: F.floor(F.log(c.cast("double")) / math.log(WIDTH)).cast("int")
    lowest = F.ceil(F.col("size_x") * least - 1e-6)
    highest = F.floor(F.least(F.col("size_x") / least, F.col("shared_x") * (1 + 1 / least) - F.col("size_x")) + 1e-6)
    by_size = x.filter("even_x").withColumns({"low": lowest, "high": highest}).filter("high >= low AND low > 0")
    by_size = by_size.withColumn("sizes", F.explode(F.sequence(step(F.col("low")), step(F.col("high"))))).drop("low", "high")
    met = by_size.join(y.filter("even_y").withColumn("sizes", step(F.col("size_y"))), ["bucket", "sizes"]).drop("sizes")
    met = met.unionByName(x.filter("NOT even_x").join(y, "bucket")).unionByName(x.filter("even_x").join(y.filter("NOT even_y"), "bucket"))
    more = met.filter((F.col("root_x") != F.col("root_y")) & once & sized & ~too_far("x", "y", least) & first & agree)
    more = table(more.select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")).distinct(), "near-more")
    again = table(verified(more, sets, least), "near-links")
    return roots if again.isEmpty() else components(found.union(again))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: key, class_id (the least key of its class), _text, the md5 of its text, and
    _chosen, whether its class keeps that text (the one with the least key, ties by md5)."""
    texts = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_name"), F.unhex(F.md5(text)).alias("_text"), F.col(text).alias("_body"))
    roots = links(texts.filter(F.col("_body").isNotNull()), "_text", "_body", "_name", least)
    some = F.regexp_like(F.coalesce("_body", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    light = table(texts.select("_id", F.when(some, F.col("_text")).alias("_text")), "near-documents")
    own = table(light.filter(F.col("_text").isNotNull()).groupBy("_text").agg(F.min("_id").alias("least")), "near-texts")
    own = own.join(roots.withColumnRenamed("node", "_text"), "_text", "left").withColumn("root", F.coalesce("root", "_text"))
    own = table(own, "near-rooted")
    order = F.struct(F.col("least").isNull().alias("none"), "least", F.col("_text").alias("text"))
    least_id = table(own.groupBy("root").agg(F.min("least").alias("class_id"), F.min(order)["text"].alias("_kept")), "near-classes")
    by_text = table(own.join(least_id, "root").select("_text", "class_id", (F.col("_text") == F.col("_kept")).alias("_chosen")), "near-membership")
    return light.join(by_text, "_text", "left").select(F.col("_id").alias(key), F.when(F.col("_text").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), "_text", "_chosen")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The documents with one row of each class, of its chosen text and least key; all columns stay.

    Rows are told apart by key and text, so other texts of a key stay, and of rows equal in both one stays. Null texts and
    texts without a word stay as they are.
    """
    rows = classes(docs, key, text, least).filter(F.col("_text").isNotNull())
    kept = F.col("_chosen") & F.col(key).eqNullSafe(F.col("class_id"))
    groups = rows.groupBy(F.col(key).alias("_gone"), F.col("_text").alias("_gone_text")).agg(F.max(kept).alias("_kept"), F.count("*").alias("_rows"))
    # what goes, and what stays once of several rows
    groups = table(groups.filter(~F.col("_kept") | (F.col("_rows") > 1)), "near-gone")
    same = F.col(key).eqNullSafe(F.col("_gone")) & (F.unhex(F.md5(text)) == F.col("_gone_text"))
    out = docs.join(groups.hint("shuffle_hash"), same, "left_anti")
    several = groups.filter("_kept")
    if several.isEmpty():
        return out
    again = docs.withColumn("_md5", F.unhex(F.md5(text))).join(several, F.col(key).eqNullSafe(F.col("_gone")) & (F.col("_md5") == F.col("_gone_text")), "left_semi")
    return out.union(again.dropDuplicates([key, "_md5"]).drop("_md5"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id")


#: All pairs that share a shingle, by both similarities, and the components of their links.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[^ \t-\r]') THEN md5(text) END AS t, text FROM documents),
w AS (SELECT t, list_filter(string_split_regex(any_value(text), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM d WHERE t IS NOT NULL GROUP BY t),
g AS (SELECT t, md5(array_to_string(ws[i:i+4], ' ')) AS g FROM (SELECT t, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w)),
sh AS (SELECT t, g, CAST(count(*) AS DOUBLE) AS w FROM g GROUP BY t, g),
sz AS (SELECT t, count(*) AS n, sum(w) AS total, max(w) AS most FROM sh GROUP BY t),
pr AS (SELECT a.t AS ta, b.t AS tb, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.t < b.t GROUP BY ALL),
pl AS (SELECT ta, tb, CAST(c AS DOUBLE) / CAST(x.n + y.n - c AS DOUBLE) >= 0.8e0 AS linked, x.most > 1 OR y.most > 1 AS uneven, x.total AS total_a, y.total AS total_b FROM pr JOIN sz x ON x.t = ta JOIN sz y ON y.t = tb),
cm AS (SELECT ta, tb, total_a, total_b, a.w AS v, b.w AS u FROM pl JOIN sh a ON a.t = ta JOIN sh b ON b.t = tb AND b.g = a.g WHERE uneven AND NOT linked),
sm AS (SELECT *, sum(v) OVER r AS below, sum(u) OVER r AS passed, sum(v) OVER p AS all_v, sum(u) OVER p AS all_u FROM cm WINDOW r AS (PARTITION BY ta, tb ORDER BY u / v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY ta, tb)),
pj AS (SELECT ta, tb FROM sm GROUP BY ta, tb HAVING sum(1e0 / ((total_a - all_v + below) / v + (total_b - all_u + all_u - passed) / u)) >= 0.8e0),
ln AS (SELECT ta, tb FROM pl WHERE linked UNION ALL SELECT ta, tb FROM pj),
both_ AS (SELECT ta, tb FROM ln UNION ALL SELECT tb, ta FROM ln),
reach AS (SELECT t, t AS r FROM w UNION SELECT b.tb, reach.r FROM reach JOIN both_ b ON b.ta = reach.t),
cc AS (SELECT t, min(r) AS r FROM reach GROUP BY t),
cl AS (SELECT r, min(doc_id) AS class_id FROM d JOIN cc USING (t) GROUP BY r)
SELECT doc_id, CASE WHEN d.t IS NULL THEN doc_id ELSE class_id END AS class_id FROM d LEFT JOIN cc ON cc.t = d.t LEFT JOIN cl ON cl.r = cc.r
"""
