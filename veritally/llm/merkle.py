"""Merkle dataset manifest: a digest of every row, a tree of digests for each source, one root, and proofs.

H is the lowercase hexadecimal sha256 of its inputs, one after the other (digests as their hexadecimal text). A leaf is H of the row's columns, each `-` if
null, else its number of UTF-8 bytes, a colon and the value. The leaves of a tree stand in order; every `ARITY` consecutive nodes (fewer at the
end, perhaps one) become their H, until one node remains. The trees' nodes, in the order of their names, are the leaves of an upper tree in the same way; its last node is
the root of the manifest.

Numbering: leaves are written sorted by ranges of (tree, key, leaf), so a row's place is its place in its range plus the rows of its tree in the ranges
before. Rows equal in all of these are interchangeable and are spread by chance, so that no value, however frequent, makes one task large.

Building (`grown`) is an event-driven combine by key: a node is an event for its parent (tree, level, number). A task keeps partial parents, each with the digests it has
so far by place. The size of the tree says how many children a parent has; when the last of them comes, the parent's digest is an event for its own parent, and so on upwards.
As leaves come in ranges, a task meets nearly all of its parents' children. What is left when its rows end, some nodes a level at the borders of the range, is
shuffled by parent and goes through the same step, until nothing is left: one round a level at most. Every resolved parent is kept as a run (its children's digests).

Proofs (`descended`) follow the links back: from the last node downwards every run hands each child its place and the run, with what it got from above. A
run of leaves thus gets its path once for all its rows: some KB (16 digests a level). A row's siblings, level by level from the leaf to the root, are its proof,
and replacing its own digest along the path gives the folded root.

Defined results: null trees (sources) are one tree, before all others; names are in the order of their UTF-8 bytes. A null key stands before all others; ties go by the leaf;
repeated rows are leaves of their own (equal ones are interchangeable). Empty and very long texts are values like others. One row alone is leaf, subroot and root, and its proof is H of nothing. An
empty table has no rows and no root. Columns whose names are results give way; other columns are not part of the leaf unless named.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, table

ARITY, DIGEST = 16, 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_EVENT = "_tree string, _size long, _level int, _at long, digest string, kids string"


def written(c):
    """A value as it enters a leaf."""
    text = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict) -> F.Column:
    """H of the columns in their order."""
    return F.sha2(F.concat(*[written(c) for c in columns.values()]), 256)


def named(c):
    """A tree's name: nulls apart from all texts and before them."""
    return F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows (stored) with _size, the rows of their _tree, and _at, their place in it (from 0) in the order of the columns."""
    # chance parts rows that are equal in all columns, which are interchangeable
    spread = rows.withColumn("_chance", F.rand(7)).repartitionByRange("_tree", *order, "_chance").sortWithinPartitions("_tree", *order, "_chance")
    rows = table(spread.drop("_chance").withColumn("_m", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_m", 33)), f"{name}-sorted")
    ranges = rows.groupBy("_tree", "_range").agg(F.min("_m").alias("_from"), F.count("*").alias("_c"))
    before = Window.partitionBy("_tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    ranges = ranges.withColumn("_size", F.sum("_c").over(Window.partitionBy("_tree"))).drop("_c")
    out = table(rows.join(ranges, ["_tree", "_range"]).withColumn("_at", F.col("_before") + F.col("_m") - F.col("_from")).drop("_m", "_range", "_from", "_before"), f"{name}-placed")
    forget(rows)
    return out


def nodes(size: int, level: int) -> int:
    """Nodes of a level of a tree with so many leaves."""
    return -(-size // ARITY**level)


def resolved(batches):
    """Runs that the events complete, and the events that are left (without kids)."""
    partial: dict[tuple, list] = {}  # by parent: children still to come, digests by place

    def batch(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["_tree", "_size", "_level", "_at", "digest", "kids"])

    for events in batches:
        done = []
        for tree, size, level, at, digest in zip(*[events.column(k).to_pylist() for k in range(5)], strict=True):
            while nodes(size, level) > 1:
                parent = (tree, size, level + 1, at // ARITY)
                held = partial.get(parent)
                if held is None:
                    held = partial[parent] = [min(ARITY, nodes(size, level) - at // ARITY * ARITY), {}]
                held[1][at % ARITY] = digest
                if len(held[1]) < held[0]:
                    break
                del partial[parent]
                kids = "".join(held[1][k] for k in range(held[0]))
                level, at, digest = level + 1, at // ARITY, hashlib.sha256(kids.encode()).hexdigest()
                done.append((tree, size, level, at, digest, kids))
        yield batch(done)
    rest = [(t, s, level - 1, at * ARITY + k, d, None) for (t, s, level, at), (_, digests) in partial.items() for k, d in digests.items()]
    yield batch(rest)


def grown(leaves: DataFrame, name: str) -> DataFrame:
    """All runs (stored) of the trees of leaves (_tree, _size, _at, digest)."""
    events = leaves.filter(F.col("_size") > 1).select("_tree", "_size", F.lit(0).alias("_level"), "_at", "digest")
    found, step = [], table(events.mapInArrow(resolved, _EVENT), f"{name}-grown")
    while True:
        found.append(step.filter(F.col("kids").isNotNull()))
        rest = step.filter(F.col("kids").isNull()).drop("kids")
        if rest.isEmpty():
            break
        rest = rest.repartition("_tree", "_level", F.floor(F.col("_at") / ARITY))
        step = table(rest.mapInArrow(resolved, _EVENT), f"{name}-grown")
    every = found[0]
    for runs in found[1:]:
        every = every.unionByName(runs)
    return every


def tops(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """(_tree, digest) of the last node of each tree."""
    last = runs.filter(F.col("_size") <= F.pow(F.lit(ARITY), "_level")).select("_tree", "digest")
    return last.unionByName(leaves.filter(F.col("_size") == 1).select("_tree", "digest"))


def descended(runs: DataFrame, above: DataFrame, name: str) -> DataFrame:
    """(_tree, _at, kids, _path) of the runs of leaves (stored): _path holds place and run of each node above, then the path `above` (_tree, _path) of the tree."""
    levels = runs.agg(F.max("_level")).first()[0] or 0
    start = runs.filter(F.col("_size") <= F.pow(F.lit(ARITY), "_level")).select("_tree", "_level", "_at").join(above, "_tree")
    come = None
    for level in range(levels, 0, -1):
        here = start.filter(F.col("_level") == level).select("_tree", "_at", "_path")
        come = here if come is None else here.unionByName(come)
        mine = runs.filter(F.col("_level") == level).select("_tree", "_at", "kids")
        met = table(mine.join(come, ["_tree", "_at"]), f"{name}-paths")
        child = F.explode(F.sequence(F.lit(0), (F.length("kids") / DIGEST).cast("int") - 1))
        come = met.withColumn("_kid", child).select("_tree", (F.col("_at") * ARITY + F.col("_kid")).alias("_at"), F.concat(F.array(F.struct(F.col("_kid").alias("at"), "kids")), "_path").alias("_path"))
    return met if levels else None


_PATH = "array<struct<at:int,kids:string>>"


def manifest(rows: DataFrame, columns: tuple = COLUMNS, key: str = "doc_id", tree: str = "source", text: str = "text", tampered=None) -> DataFrame:
    """key, leaf, subroot, root, proof (siblings from the leaf to the root), proof_sha256, folded_root and verified of every row.

    `tampered` maps a row to the column expression of its altered text, null where it is unaltered; the folded root is that of the altered row under the original proof.
    """
    plain = {c: F.col(c) for c in columns}
    altered = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf(plain | {text: tampered}))
    # written first, as finding the ranges would read and hash all texts once more
    hashed = table(rows.select(F.col(key).alias("_key"), named(F.col(tree)).alias("_tree"), leaf(plain).alias("digest"), altered.alias("_altered")), "merkle-leaves")
    leaves = placed(hashed, ["_key", "digest"], "merkle")
    forget(hashed)
    runs = grown(leaves, "merkle")
    roots = placed(tops(leaves, runs).select(F.col("_tree").alias("_name"), F.lit("").alias("_tree"), "digest"), ["_name"], "merkle-top")
    upper = grown(roots, "merkle-top")
    root = F.coalesce(F.lit((tops(roots, upper).first() or {"digest": None})["digest"]), F.lit(None).cast("string"))
    # the path of a tree from its node among the roots; one tree alone has none
    runs_above = descended(upper, roots.limit(1).select("_tree", F.array().cast(_PATH).alias("_path")), "merkle-top")
    if runs_above is None:
        above = roots.select(F.col("_name").alias("_tree"), F.col("digest").alias("subroot"), F.array().cast(_PATH).alias("_path"))
    else:
        own = roots.withColumn("_run", F.floor(F.col("_at") / ARITY)).withColumn("_kid", (F.col("_at") % ARITY).cast("int"))
        own = own.select("_name", "digest", "_run", "_kid").join(runs_above.select(F.col("_at").alias("_run"), "kids", "_path"), "_run")
        above = own.select(F.col("_name").alias("_tree"), F.col("digest").alias("subroot"), F.concat(F.array(F.struct(F.col("_kid").alias("at"), "kids")), "_path").alias("_path"))
    above = table(above, "merkle-above")
    alone = leaves.filter(F.col("_size") == 1).join(above.drop("subroot"), "_tree").select("_tree", "_key", "digest", "_altered", F.col("_path").alias("_steps"))
    paths = descended(runs, above.drop("subroot"), "merkle")
    if paths is not None:
        own = leaves.filter(F.col("_size") > 1).withColumn("_run", F.floor(F.col("_at") / ARITY))
        met = own.join(paths.withColumnRenamed("_at", "_run"), ["_tree", "_run"])
        steps = F.concat(F.array(F.struct((F.col("_at") % ARITY).cast("int").alias("at"), "kids")), "_path")
        alone = alone.unionByName(met.select("_tree", "_key", "digest", "_altered", steps.alias("_steps")))
    left, right = lambda x: F.substring(x["kids"], F.lit(1), x["at"] * DIGEST), lambda x: F.substring(x["kids"], x["at"] * DIGEST + DIGEST + 1, F.lit(ARITY * DIGEST))
    proof = F.array_join(F.transform("_steps", lambda x: F.concat(left(x), right(x))), "")
    folded = F.aggregate("_steps", F.coalesce("_altered", "digest"), lambda d, x: F.sha2(F.concat(left(x), d, right(x)), 256))
    out = alone.join(above.select("_tree", "subroot"), "_tree").select(F.col("_key").alias(key), F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof"), folded.alias("folded_root"))
    return out.withColumn("proof_sha256", F.sha2("proof", 256)).withColumn("verified", F.col("folded_root") == F.col("root"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", UPPER, LOWER))
    return manifest(docs, tampered=lowered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql(levels: int = 6, upper: int = 4) -> str:
    """The manifest for at most 16 ** levels rows of a source and 16 ** upper sources."""

    def tree(name: str, depth: int) -> str:
        step = """{a}{k} AS (SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest,
  CASE WHEN n > 1 THEN string_agg(digest, '' ORDER BY pos) END AS kids FROM {a}{j} GROUP BY tree, pos // 16, n)"""
        return ",\n".join(step.format(a=name, k=k, j=k - 1) for k in range(1, depth + 1))

    hashed = "sha256(" + " || ".join("coalesce(strlen({x}) || ':' || {x}, '-')".format(x=f"CAST({c} AS VARCHAR)" if c != "text" else "{text}") for c in COLUMNS) + ")"
    crc = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)))"""
    steps = [("n", k, "l.tree", "l.pos") for k in range(1, levels + 1)] + [("t", k, "0", "r.pos") for k in range(1, upper + 1)]
    joins = "\n".join(f"JOIN {a}{k} AS {a}{k} ON {a}{k}.tree = {t} AND {a}{k}.pos = {pos} // {16**k}" for a, k, t, pos in steps)
    place = {(a, k): f"CAST({pos} // {16 ** (k - 1)} % 16 AS BIGINT)" for a, k, _, pos in steps}
    halves = ", ".join(f"{a}{k}.kids[:64 * {place[a, k]}] AS left_{a}{k}, {a}{k}.kids[64 * {place[a, k]} + 65:] AS right_{a}{k}" for a, k, *_ in steps)
    folds, last = [], "f0"
    for n, (a, k, *_) in enumerate(steps, 1):
        folds.append(f"g{n} AS (SELECT *, CASE WHEN left_{a}{k} IS NULL THEN {last} ELSE sha256(left_{a}{k} || {last} || right_{a}{k}) END AS f{n} FROM g{n - 1})")
        last = f"f{n}"
    siblings = " || ".join(f"coalesce(left_{a}{k} || right_{a}{k}, '')" for a, k, *_ in steps)
    return f"""WITH d AS (SELECT doc_id, coalesce('s' || source, 'n') AS tree, {hashed.format(text='text')} AS leaf,
  CASE WHEN text IS NOT NULL AND {crc} % 5 = 0 THEN {hashed.format(text=f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
n0 AS (SELECT tree, pos, n, leaf AS digest FROM l),
{tree('n', levels)},
r AS (SELECT tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS pos FROM n{levels}),
t0 AS (SELECT 0 AS tree, pos, count(*) OVER () AS n, digest FROM r),
{tree('t', upper)},
g0 AS (SELECT l.doc_id, l.leaf, r.digest AS subroot, (SELECT digest FROM t{upper}) AS root, coalesce(l.altered, l.leaf) AS f0, {halves}
  FROM l JOIN r ON r.name = l.tree
{joins}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({siblings}) AS proof_sha256, {last} AS folded_root, {last} = root AS verified FROM g{len(steps)}"""


SQL = _sql()
