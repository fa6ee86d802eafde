"""Mixing sources to target weights by Pfair scheduling [native: built-in functions only].

Each source is a periodic task of rate w (its target weight; the weights add up to 1) and its rows form blocks of
`block_rows` rows. Block i (from 0) of a source is released at slot floor(i / w) and due by slot ceil((i + 1) / w);
earliest deadline first among the released blocks (ties by source) gives every slot one block, all windows are met, and
after any number of slots a source has had within less than one block of its target.

Weights are whole numbers, so windows are exact and nothing drifts: a weight is W_g of the sum W of all. Given targets count
as they are written (0.62345 is 62345 / 100000) if the sum stays below 2 ** 31; otherwise, and for shares to the power
`temperature`, they are rounded to parts of 2 ** 31. A weight under a millionth counts as a millionth.

The schedule is cut into stretches of slots, and each is scheduled by itself, in parallel, because the state at its first slot
T is known without what was before. Of each source the blocks due by T are done, and one more may be: a block released
before T and due after it. Which of these are done is what the greedy choice by deadline gives, where a block is taken if
all blocks taken still fit between their releases and T beside those due by T; the number that fits after slot r is
T - r - sum over sources of max(0, floor(w T) - ceil(w r)). (An exchange argument shows that this is the state that earliest
deadline first reaches.) A stretch has at least 1 / (least weight) slots, so the work is proportional to slots times sources.
Only stretches that some block's window touches are scheduled. The weights are one array in the plan.

Rows of a source are put in the order of a seeded hash. Their numbers are found without bringing a source together:
a source is cut into hash ranges of about `bucket_rows` rows, each range is numbered by itself, and the small table of
range sizes gives the offsets. No row is dropped: when a source is exhausted its later slots stay empty.

Defined results: a null source is a source of its own; a null or repeated key is allowed (ties go by the text's hash, rows
equal in both are interchangeable); sources without a target, or with one that is not positive, get no slot (release,
deadline and slot are null; block and place are given), also if no source has one; targets of absent sources do not count; an empty table gives an empty
result; texts are only hashed, so their length does not matter; other columns are carried along (those with the names of
results give way).
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table


#: Sources up to which their sizes (some bytes each) are broadcast; ranges of a source at most (they grow beyond).
BROADCAST, RANGES = 100_000, 1_000_000


def numbered(df: DataFrame, group: str, key: str, text: str, bucket_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with _g, _bucket and _in (the place within the bucket, from 1) in the order of a seeded hash; the buckets with
    _before, the rows of the group in earlier ones, and _c, their own; and the sizes of the groups."""
    df = df.withColumn("_g", F.coalesce(F.concat(F.lit("s"), F.col(group)), F.lit("n")))
    df = df.withColumn("_tie", F.coalesce(F.md5(text), F.lit(""))).withColumn("_u", F.md5(F.concat(F.lit("42|"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.col("_tie"))))
    sizes = table(df.groupBy("_g").agg(F.count("*").alias("_rows")), "mix-sizes")
    ranges = F.least(F.ceil(F.col("_rows") / F.lit(bucket_rows)), F.lit(RANGES))
    # the first 32 bits of the hash, as a share of the number line, give the range
    df = df.join(F.broadcast(sizes) if sizes.count() <= BROADCAST else sizes, "_g").withColumn("_bucket", F.floor(F.conv(F.substring("_u", 1, 8), 16, 10).cast("long") * ranges / F.lit(float(1 << 32))))
    counts = df.groupBy("_g", "_bucket").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = table(counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).select("_g", "_bucket", "_before", "_c"), "mix-offsets")
    within = Window.partitionBy("_g", "_bucket").orderBy("_u", F.col(key), "_tie")
    return df.withColumn("_in", F.row_number().over(within)).drop("_tie", "_u", "_rows"), offsets, sizes


#: Sum of rounded weights, and the least weight.
WHOLE, LEAST = 1 << 31, 1e-6
#: Slots of a stretch at least.
STRETCH = 256


def weights(sizes: DataFrame, targets: dict | None, temperature: float) -> list[tuple[str, int]]:
    """Name and whole weight of each source with a share, by name; a row of each source comes to the driver, never rows."""
    if targets is None:
        raw = [(r["_g"], r["_raw"]) for r in sizes.select("_g", F.pow(F.col("_rows").cast("double"), F.lit(temperature)).alias("_raw")).collect()]
    else:
        named = {"n" if s is None else f"s{s}": Fraction(str(w)) for s, w in targets.items()}
        raw = [(r["_g"], named[r["_g"]]) for r in sizes.select("_g").collect() if named.get(r["_g"], 0) > 0]
    raw.sort()
    if targets is not None and raw:
        unit = math.lcm(*[w.denominator for _, w in raw])
        whole = [int(w * unit) for _, w in raw]
        common = math.gcd(*whole)
        whole = [w // common for w in whole]
        if sum(whole) <= WHOLE and min(whole) >= LEAST * sum(whole):
            return [(g, w) for (g, _), w in zip(raw, whole, strict=True)]
    total = sum(float(w) for _, w in raw)
    return [(g, max(int(WHOLE * LEAST) + 1, math.floor(float(w) / total * WHOLE + 0.5))) for g, w in raw]


def schedule(blocks: DataFrame, shares: list[tuple[str, int]]) -> DataFrame:
    """(_g, block, release, deadline, slot) of the stretches that the windows of the blocks (_g, block) touch."""
    names = F.split(F.lit("\n".join(g.encode().hex() for g, _ in shares)), "\n")
    whole = F.expr(f"array({', '.join(f'{w}L' for _, w in shares)})")  # of literals, so it is one
    total = sum(w for _, w in shares)
    size = max(STRETCH, -(-total // min(w for _, w in shares)))
    at = F.array_position(names, F.lower(F.hex(F.encode("_g", "utf-8"))))
    windows = blocks.withColumn("_w", F.get(whole, (at - 1).cast("int"))).selectExpr(
        f"(block * {total} div _w) div {size} AS a", f"((((block + 1) * {total} + _w - 1) div _w) - 1) div {size} AS b"
    )
    stretches = table(windows.select(F.explode(F.sequence("a", "b")).alias("stretch")).distinct(), "mix-stretches")
    # where sources are at the first slot T: floors, and the blocks whose window holds T, by deadline
    df = stretches.withColumn("w", whole).selectExpr("w", f"stretch * {size} AS t")
    df = df.selectExpr("*", f"transform(w, x -> x * t div {total}) AS low")
    df = df.selectExpr("*", f"array_sort(filter(transform(w, (x, k) -> named_struct('due', ((low[k] + 1) * {total} + x - 1) div x, 'k', k, 'release', low[k] * {total} div x, 'open', x * t % {total} > 0)), x -> x.open)) AS held")
    df = df.selectExpr("*", "t - aggregate(low, 0L, (s, x) -> s + x) AS wanted", "coalesce(t - array_min(transform(held, x -> x.release)), 0L) AS back")
    fits = f"j - aggregate(zip_with(w, low, (x, m) -> greatest(0L, m - (x * (t - j) + {total - 1}) div {total})), 0L, (s, x) -> s + x)"
    df = df.selectExpr("*", f"IF(back > 0, transform(sequence(1L, back), j -> {fits}), CAST(array() AS array<bigint>)) AS room")
    taken = """aggregate(held, named_struct('room', room, 'up', CAST(array() AS array<int>)), (s, x) ->
        IF(size(s.up) < wanted AND NOT exists(slice(s.room, CAST(t - x.release AS int), CAST(back AS int)), r -> r < 1),
            named_struct('room', transform(s.room, (r, j) -> IF(j + 1 >= t - x.release, r - 1, r)), 'up', concat(s.up, array(x.k))), s), s -> s.up)"""
    # the inner list is computed once, as the only element of an outer one
    df = df.selectExpr("w", "t", f"aggregate(array({taken}), low, (s, up) -> transform(s, (m, k) -> IF(array_contains(up, k), m + 1, m))) AS now")
    # earliest deadline first over the slots, in parts, so that lists stay short while they grow
    part = max(1, int(size**0.5))
    ready = f"filter(transform(s.now, (i, k) -> named_struct('due', ((i + 1) * {total} + w[k] - 1) div w[k], 'k', k, 'release', i * {total} div w[k], 'block', i, 'slot', slot)), x -> x.release <= slot)"
    step = f"(s, slot) -> aggregate(array(array_min({ready})), s, (s2, x) -> named_struct('now', transform(s2.now, (i, k) -> IF(k = x.k, i + 1, i)), 'out', concat(s2.out, array(x))))"
    none = "CAST(array() AS array<struct<due:bigint,k:int,release:bigint,block:bigint,slot:bigint>>)"
    inner = f"aggregate(sequence(t + p * {part}, least(t + (p + 1) * {part}, t + {size}) - 1), named_struct('now', o.now, 'out', {none}), {step})"
    outer = f"aggregate(sequence(0L, {-(-size // part) - 1}L), named_struct('now', now, 'out', CAST(array() AS array<array<struct<due:bigint,k:int,release:bigint,block:bigint,slot:bigint>>>)), (o, p) -> aggregate(array({inner}), o, (o2, x) -> named_struct('now', x.now, 'out', concat(o2.out, array(x.out)))), o -> flatten(o.out))"
    plan = df.selectExpr(f"explode({outer}) AS x")
    name = F.decode(F.unhex(F.get(names, F.col("x.k"))), "utf-8")
    return plan.select(name.alias("_g"), "x.block", "x.release", F.col("x.due").alias("deadline"), "x.slot")


def mix_sources(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", targets: dict | None = None, temperature: float = 0.5, block_rows: int = 16, bucket_rows: int = 500) -> DataFrame:
    """Add block, release, deadline, slot and place (within the block) to every row; order by slot, place to read the mix."""
    rows, offsets, sizes = numbered(docs.drop(*RESULTS), source, key, text, bucket_rows)
    shares = weights(sizes, targets, temperature)
    buckets = offsets.select("_g", "_bucket", "_before")
    if shares:
        last = F.floor((F.col("_before") + F.col("_c") - 1) / block_rows)
        every = offsets.select("_g", "_bucket", F.explode(F.sequence(F.floor(F.col("_before") / block_rows), last)).alias("block"))
        every = table(every.filter(F.col("_g").isin([g for g, _ in shares])) if len(shares) < sizes.count() else every, "mix-blocks")
        plan = table(schedule(every, shares), "mix-plan")
        # the slots of a bucket's blocks come to the bucket, so rows stay where they were numbered
        slots = every.join(plan, ["_g", "block"]).groupBy("_g", "_bucket").agg(F.array_sort(F.collect_list(F.struct("block", "release", "deadline", "slot"))).alias("_slots"))
        buckets = buckets.join(slots, ["_g", "_bucket"], "left")
    else:
        buckets = buckets.withColumn("_slots", F.lit(None).cast("array<struct<block:bigint,release:bigint,deadline:bigint,slot:bigint>>"))
    rows = rows.join(table(buckets, "mix-buckets"), ["_g", "_bucket"]).withColumn("_n", F.col("_before") + F.col("_in") - 1)
    rows = rows.withColumn("block", F.floor(F.col("_n") / block_rows).cast("long")).withColumn("place", (F.col("_n") % block_rows).cast("long"))
    mine = F.get("_slots", (F.col("block") - F.floor(F.col("_before") / block_rows)).cast("int"))
    rows = rows.withColumns({n: mine[n] for n in ("release", "deadline", "slot")})
    return rows.drop("_g", "_bucket", "_in", "_n", "_before", "_slots")


RESULTS = ("block", "release", "deadline", "slot", "place")
PARAMETERS = {"temperature": 0.5, "block_rows": 16}


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.md5("text").alias("text"))
    return mix_sources(docs, **PARAMETERS).select("doc_id", "source", "block", "release", "deadline", "slot")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS g, coalesce(md5(md5(text)), '') AS tie FROM documents),
u AS (SELECT *, md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || tie) AS u FROM d),
b AS (SELECT doc_id, source, g, (row_number() OVER (PARTITION BY g ORDER BY u, doc_id, tie) - 1) // 16 AS block FROM u),
raw AS (SELECT g, pow(CAST(count(*) AS DOUBLE), 0.5) AS raw, max(block) + 1 AS blocks FROM b GROUP BY g),
p AS (SELECT g, blocks, greatest(2148, CAST(floor(raw / (SELECT sum(raw ORDER BY g) FROM raw) * 2147483648 + 0.5) AS BIGINT)) AS w FROM raw),
tasks AS (SELECT list(CAST(w AS HUGEINT) ORDER BY g) AS ws, list(g ORDER BY g) AS gs, sum(CAST(w AS HUGEINT)) AS total, (SELECT max((blocks * (SELECT sum(CAST(w AS HUGEINT)) FROM p) + w - 1) // w) FROM p) AS slots FROM p),
sched AS (
  SELECT CAST(-1 AS HUGEINT) AS slot, list_transform(ws, lambda x: CAST(0 AS HUGEINT)) AS nx, {'due': CAST(0 AS HUGEINT), 'k': CAST(0 AS BIGINT), 'release': CAST(0 AS HUGEINT), 'i': CAST(0 AS HUGEINT)} AS pick FROM tasks
  UNION ALL
  SELECT slot + 1, list_transform(nx, lambda x, k: CASE WHEN k = best.k THEN x + 1 ELSE x END), best FROM (
    SELECT slot, nx, list_min(list_filter(list_transform(nx, lambda x, k: {'due': ((x + 1) * total + ws[k] - 1) // ws[k], 'k': CAST(k AS BIGINT), 'release': (x * total) // ws[k], 'i': x}),
      lambda y: y.release <= slot + 1)) AS best FROM sched, tasks WHERE slot + 1 < slots)),
plan AS (SELECT gs[pick.k] AS g, pick.i AS block, pick.release AS release, pick.due AS due, slot FROM sched, tasks WHERE slot >= 0)
SELECT doc_id, source, CAST(b.block AS BIGINT) AS block, CAST(release AS BIGINT) AS release, CAST(due AS BIGINT) AS deadline, CAST(slot AS BIGINT) AS slot
FROM b JOIN plan ON plan.g = b.g AND plan.block = b.block
"""
