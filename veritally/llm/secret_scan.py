r"""Secret scans by a trigram inverted index [native: built-in functions only].

For each rule a Boolean trigram query is derived from its regular expression: a conjunction of trigrams for each string
that every match must contain one of. The index holds, for each trigram that some query names, the texts whose lower-case
form contains it; postings are intersected per clause, and the rule's expression then verifies its candidates only. Rules
whose expression has no mandatory trigram (such as runs of hexadecimal digits) are run over every text.

Spans are found without a UDF: the pieces between matches and the matches give all offsets by addition, in code points.

The rules `assign`, `access` and `hex` are the base. They take the leftmost non-overlapping matches and drop those that
are too short afterwards; the other kinds only add spans.

Defined results: a null text is an empty one and has no span; copies of a text share one posting; repeated rows are kept;
other columns are carried along. Very long texts are scanned whole. Spans of different kinds may overlap.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: Keep a match only if this group has so many characters.
    group: int = 0
    least: int = 1


_NAMES = "|".join(either_case(x) for x in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
#: The order of the kinds is the order of spans with one start. `AKIA[A-Z0-9]+` of 20+ characters and `[0-9a-f]+` of 24+
#: are written with their length in the expression: a run is taken whole either way.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("login", r"[a-z]+://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/@:]+@[A-Za-z0-9.-]+"),
)
BASE = ("assign", "access", "hex")

# ---------------------------------------------------------------- from an expression to a trigram query

#: Sets of strings above this size are closed: their trigrams are required and a new set begins.
MOST_STRINGS = 64


def _exact(nodes) -> set[str] | None:
    """All strings that the nodes match, in lower case; None if they are not few."""
    found = {""}
    for op, arg in nodes:
        if op is sre.LITERAL:
            here = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            here = {chr(c).lower() for _, c in arg}
        elif op is sre.SUBPATTERN:
            here = _exact(arg[3])
        elif op is sre.BRANCH:
            parts = [_exact(x) for x in arg[1]]
            here = None if None in parts else set().union(*parts)
        elif op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 4:
            one = _exact(arg[2])
            here = None
            if one is not None and len(one) ** arg[1] <= MOST_STRINGS:
                powers = [{""}]
                for _ in range(arg[1]):
                    powers.append({a + b for a in powers[-1] for b in one})
                here = set().union(*powers[arg[0] :])
        else:
            here = None
        if here is None or len(here) * len(found) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in here}
    return found


def _any(clauses: set[frozenset]) -> set[frozenset]:
    """Without clauses that another one implies."""
    return {c for c in clauses if not any(d < c for d in clauses)}


def _required(strings: set[str]) -> set[frozenset]:
    return _any({frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings})


def _and(a: set[frozenset], b: set[frozenset]) -> set[frozenset]:
    if len(a) * len(b) > 4 * MOST_STRINGS:
        return a  # weaker, so still sound
    return _any({x | y for x in a for y in b})


def _query(nodes) -> set[frozenset]:
    everything: set[frozenset] = {frozenset()}
    query, open_ = everything, {""}
    for node in nodes:
        here = _exact([node])
        if here is not None and len(here) * len(open_) <= MOST_STRINGS:
            open_ = {a + b for a in open_ for b in here}
            continue
        query, open_ = _and(query, _required(open_)), {""}
        op, arg = node
        if here is not None:
            open_ = here
        elif op is sre.SUBPATTERN:
            query = _and(query, _query(arg[3]))
        elif op is sre.BRANCH:
            query = _and(query, _any(set().union(*[_query(x) for x in arg[1]])))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            query = _and(query, _query(arg[2]))
    return _and(query, _required(open_))


def trigram_query(regex: str) -> list[frozenset]:
    """Clauses of trigrams (in lower case): every match contains all trigrams of some clause. [] if nothing is mandatory."""
    clauses = _query(_parser.parse(regex))
    return [] if frozenset() in clauses else sorted(clauses, key=sorted)


# ---------------------------------------------------------------- index, candidates, verification


def postings(docs: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """The inverted index: one row for each trigram of the vocabulary and each distinct key whose text has it."""
    low = docs.select(F.col(key).alias("_k"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    found = F.filter(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)]), lambda x: x.isNotNull())
    return table(low.select("_k", F.explode(found).alias("_trigram")).distinct(), "secret-postings")


def candidates(index: DataFrame, queries: dict[str, list[frozenset]], trigrams: list[str]) -> DataFrame:
    """For each key the kinds for which its postings satisfy some clause."""
    at = {t: k for k, t in enumerate(trigrams)}
    clauses = [(kind, n, at[t], len(c)) for kind, q in queries.items() for n, c in enumerate(q) for t in sorted(c)]
    wanted = F.create_map(*[x for t in range(len(trigrams)) for x in (F.lit(t), F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("clause"), F.lit(size).alias("size")) for kind, n, at_, size in clauses if at_ == t]))])
    rows = index.select("_k", F.explode(wanted[F.col("_trigram")]).alias("c"))
    whole = rows.groupBy("_k", "c.kind", "c.clause", "c.size").agg(F.count("*").alias("_has")).filter(F.col("_has") == F.col("size"))
    return table(whole.groupBy("_k").agg(F.collect_set("kind").alias("_kinds")), "secret-candidates")


def spans(text: Column, rule: Rule) -> Column:
    """start and end (exclusive), in code points, of the rule's matches."""
    regex = F.lit(rule.regex)
    pieces, whole = F.split(text, rule.regex, -1), F.regexp_extract_all(text, regex, F.lit(0))
    lengths = F.transform(whole, lambda m: F.length(m))
    kept = F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), lambda g: F.length(g) >= rule.least) if rule.group else F.transform(whole, lambda m: F.lit(True))
    parts = F.arrays_zip(F.transform(pieces, lambda p: F.length(p)).alias("gap"), lengths.alias("size"), kept.alias("kept"))

    def add(state, x):
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), F.coalesce(x["kept"], F.lit(False)).alias("kept")))).alias("out"))

    return F.filter(_running(parts, "struct<start:int,end:int,kept:boolean>", lambda part, at: (part, add)), lambda x: x["kept"])


#: Elements that are added to a list one by one, before the list is put after the earlier ones.
RUN = 128


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once: what a lambda reads from outside is computed at every call."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(found: Column, kind: str, start) -> Column:
    """All outputs of a fold whose state has `at` and a list `out` of `kind`, over a long array.

    The fold is made in runs, so the lists that grow are short, and the time is nearly linear. `start` takes a run and the `at`
    before it and gives the array to fold and the step.
    """
    none = F.array().cast(f"array<{kind}>")

    def whole(every):
        def run(state, p):
            rows, step = start(F.slice(every, p * RUN + 1, F.lit(RUN)), state["at"])
            done = F.aggregate(rows, F.struct(state["at"].alias("at"), none.alias("out")), step)
            return _bound(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(d["out"])).alias("out")))

        runs = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / RUN).cast("int"))
        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(every) > 0, F.flatten(F.aggregate(runs, first, run, lambda s: s["out"]))).otherwise(none)

    return _bound(found, whole)


def _of_kind(found: str, k: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))


def count_of(found: str, k: int) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == k)).cast("long")


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add `found`: the spans of all rules as array<struct<start, kind number, end>>, in that order."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    docs = docs.withColumn("_k", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    index = postings(docs, "_k", text, trigrams)
    hits = candidates(index, {k: q for k, q in queries.items() if q}, trigrams)
    out = docs.join(hits.hint("shuffle_hash"), "_k", "left").withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    empty = F.array().cast("array<struct<start:int,end:int,kept:boolean>>")
    for r in rules:
        out = out.withColumn(f"_s_{r.kind}", F.when(F.array_contains("_kinds", r.kind), spans(F.col("_t"), r)).otherwise(empty) if queries[r.kind] else spans(F.col("_t"), r))
    every = F.concat(*[_of_kind(f"_s_{r.kind}", k) for k, r in enumerate(rules)])
    return out.withColumn("found", F.array_sort(every)).drop("_k", "_kinds", "_t", *[f"_s_{r.kind}" for r in rules])


def written(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with every span, overlapping ones joined, replaced by [secret].

    `found` is in the order of starts. Each run of spans reads its part of the text once.
    """

    def start(run, at):
        end = F.greatest(at, F.array_max(F.transform(run, lambda x: x["end"])))
        # the run's part of the text goes along with its spans
        part = F.struct(at.alias("from"), F.substring(text, at + 1, end - at).alias("text"))
        rows = _bound(part, lambda t: F.transform(run, lambda x: F.struct(t["from"].alias("from"), t["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"))))

        def add(state, x):
            gap = F.substring(x["text"], state["at"] - x["from"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
            piece = F.concat(gap, F.when(x["start"] >= state["at"], F.lit("[secret]")).otherwise(F.lit("")))
            return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))

        return rows, add

    def whole(spans):
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.when(F.size(spans) > 0, F.concat(F.array_join(_running(spans, "string", start), ""), F.substring(text, last + 1, F.length(text)))).otherwise(text)

    return _bound(found, whole)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs).drop("text")
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    return out.select(
        "doc_id",
        *[count_of("found", k).alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )


def _sql() -> str:
    """Every rule over every text, without an index."""
    each = []
    for k, r in enumerate(RULES):
        regex = r.regex.replace("'", "''")
        kept = f"list_transform(regexp_extract_all(t, '{regex}', {r.group}), lambda m: length(m) >= {r.least})"
        each.append(f"SELECT r, {k} AS k, '{r.kind}' AS kind, list_transform(string_split_regex(t, '{regex}'), lambda p: length(p)) AS gaps, list_transform(regexp_extract_all(t, '{regex}'), lambda m: length(m)) AS sizes, {kept} AS kept FROM d WHERE regexp_matches(t, '{regex}')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(each)}),
u AS (SELECT r, k, kind, i, gaps[i] AS gap, sizes[i] AS size, kept[i] AS kept FROM (SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM m)),
s AS (SELECT r, k, kind, kept, sum(gap + size) OVER w - size AS b, sum(gap + size) OVER w AS e FROM u WINDOW w AS (PARTITION BY r, k ORDER BY i)),
f AS (SELECT r, k, kind || ':' || b || ':' || e AS x, b FROM s WHERE kept),
g AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  coalesce(string_agg(x, ',' ORDER BY b, k) FILTER (k < 3), '') AS base, string_agg(x, ',' ORDER BY b, k) AS spans FROM f GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


SQL = _sql()
