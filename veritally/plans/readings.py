"""Named queries of answers that are read and graded: texts made from the numbers and names of given rows, in the shapes in which
answers come, and SQL that computes what must be read in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts, symbolic, tasks, timed
from . import fixtures as fx
from .catalogue import query

# ---------------------------------------------------------------- mathematics

#: A solution's numbers: p / q with its multiple by m, n, a and b, a digit s, and e, by which the right answer differs (0 for two of three).
_NUMBERS = [
    "o_orderkey", "o_orderkey % 7 AS k", "o_custkey % 19 - 9 AS p", "o_orderkey % 6 + 2 AS q", "o_custkey % 4 + 1 AS m", "1000 + o_orderkey AS n", "o_custkey % 90 - 40 AS a", "o_orderkey % 45 AS b", "o_orderkey % 5 AS s",
    "CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 4 ELSE 0 END AS e",
]
_MATHS = f"n AS (SELECT {', '.join(_NUMBERS)} FROM orders)"


def _solutions(spark, d):
    """(o_orderkey, task_type, text, answer): a box, a number after hashes, formulas below a heading, a display below an announcement, a
    rest of a line, a last number, a decimal."""
    n = fx.read(spark, d, "orders").selectExpr(*_NUMBERS)
    said = lambda form, *numbers: F.format_string(form, *[F.expr(x).cast("long") for x in numbers])
    shapes = [
        (said("Both sides give $%d$, so we find \\boxed{\\frac{%d}{%d}} in the end.", "b", "p", "q"), said("%d/%d", "p * m + e", "q * m")),
        (said("Counting all of them again,\n#### %,d", "n"), said("%d", "n + e")),
        (said("\\boxed is not closed {%d\n\n## Final answer\nThe sides are $%d$ and then \\(%d\\).", "p", "a", "b"), said("%d", "b + e")),
        (said("We take %d.\nFinal answer:\n\\[ \\dfrac{%d}{%d} \\]\n", "a", "p", "q"), said("\\frac{%d}{%d}", "p * m + e", "q * m")),
        (said("It was %d at first.\nThe answer is: $x_{%d}$.", "b", "s"), said("x_%d", "s + e")),
        (said("There are %d and then %d of them, which is what took all of the long afternoon to find", "b", "a"), said("%d", "a + e")),
        (said("Answer: %d.%02d \\text{ cm}", "b", "q"), said("%d.%02d", "b + e", "q")),
    ]
    side = lambda i: F.get(F.array(*[x[i] for x in shapes]), F.col("k").cast("int"))
    return n.select("o_orderkey", F.lit("math").alias("task_type"), side(0).alias("text"), side(1).alias("answer"))


_SAID = "CASE k WHEN 0 THEN p || '/' || q WHEN 1 THEN CAST(n AS VARCHAR) WHEN 2 THEN CAST(b AS VARCHAR) WHEN 3 THEN p || '/' || q WHEN 4 THEN 'x_' || s WHEN 5 THEN CAST(a AS VARCHAR) ELSE b || '.' || lpad(CAST(q AS VARCHAR), 2, '0') END"
_X, _Y = (f"CAST(CASE k WHEN 0 THEN {f} WHEN 3 THEN {f} WHEN 1 THEN {n} WHEN 2 THEN {b} WHEN 5 THEN {a} ELSE {c} END AS DOUBLE)" for f, n, b, a, c in (
    ("CAST(p AS DOUBLE) / q", "n", "b", "a", "b + CAST(q AS DOUBLE) / 100"), ("CAST(p * m + e AS DOUBLE) / (q * m)", "n + e", "b + e", "a + e", "b + e + CAST(q AS DOUBLE) / 100")))


@query(f"WITH {_MATHS} SELECT o_orderkey, {_SAID} AS extracted FROM n")
def solutions_read(spark, d):
    return tasks.extracted(_solutions(spark, d), "text").select("o_orderkey", "extracted")


@query(f"WITH {_MATHS}, v AS (SELECT *, {_X} AS x, {_Y} AS y FROM n) SELECT o_orderkey, CAST(CASE WHEN k = 4 THEN e = 0 ELSE abs(x - y) <= greatest(1e-4 * greatest(abs(x), abs(y)), 1e-4) END AS INTEGER) AS correct FROM v")
def solutions_graded(spark, d):
    return tasks.graded(_solutions(spark, d), "text").select("o_orderkey", "correct")


@query(f"""WITH {_MATHS}, v AS (SELECT *, {_X} AS x, {_Y} AS y FROM n)
SELECT o_orderkey, CASE WHEN k = 4 THEN e = 0 WHEN abs(x - y) <= greatest(1e-4 * greatest(abs(x), abs(y)), 1e-4) THEN TRUE ELSE FALSE END AS same FROM v""")
def solutions_verified(spark, d):
    """Whether two solutions state the same number or text, or else the same as symbols or at their coarser figures."""
    return _solutions(spark, d).select("o_orderkey", symbolic.answers_agree_udf("text", "answer").alias("same"))


@query(f"""WITH {_MATHS}, v AS (SELECT *, {_X} AS x, {_Y} AS y FROM n)
SELECT o_orderkey, 'graded' AS verdict, CASE WHEN k = 4 THEN e = 0 WHEN abs(x - y) <= greatest(1e-4 * greatest(abs(x), abs(y)), 1e-4) THEN TRUE ELSE FALSE END AS same FROM v""")
def solutions_in_time(spark, d):
    """The same in a process of its own that a value may keep busy for some seconds only."""
    found = _solutions(spark, d).select("o_orderkey", timed.answers_agree_within()("text", "answer").alias("g"))
    return found.select("o_orderkey", F.col("g.verdict").alias("verdict"), F.col("g.value").alias("same"))


# ---------------------------------------------------------------- options

_LETTERS = "l AS (SELECT event_id, event_id % 7 AS k, chr(CAST(65 + user_id % 4 AS INTEGER)) AS g, chr(CAST(65 + event_id % 4 AS INTEGER)) AS s, chr(CAST(65 + event_id // 4 % 4 AS INTEGER)) AS o FROM events)"


def _choices(spark, d):
    """(event_id, task_type, text, answer, choices): the letter said among others."""
    rows = fx.read(spark, d, "events").selectExpr("event_id", "event_id % 7 AS k", "char(65 + user_id % 4) AS g", "char(65 + event_id % 4) AS s", "char(65 + (event_id div 4) % 4) AS o")
    shapes = [
        F.format_string("I would pick (%s).\nFinal answer: (%s)", "o", "s"), F.concat(F.lit("option "), F.lower("s")), F.format_string("Not that one, the letter: %s", "s"),
        F.format_string("(%s) or (%s)?\nI select %s", "o", "s", "s"), F.concat(F.lit(" "), F.lower("s"), F.lit(" ")), F.lit("there is nothing here to say"), F.format_string("The choice: %s!\n\n(%s)", "o", "s"),
    ]
    said = F.get(F.array(*shapes), F.col("k").cast("int"))
    return rows.select("event_id", F.lit("mcqa").alias("task_type"), said.alias("text"), F.col("g").alias("answer"), F.array(*[F.lit(x) for x in ("w", "x", "y", "z")]).alias("choices"))


@query(f"WITH {_LETTERS} SELECT event_id, CASE WHEN k <> 5 THEN lower(s) END AS key FROM l")
def choices_read(spark, d):
    return tasks.agreement_keys(_choices(spark, d), "text").select("event_id", "key")


@query(f"WITH {_LETTERS} SELECT event_id, CAST(k <> 5 AND s = g AS INTEGER) AS correct FROM l")
def choices_graded(spark, d):
    return tasks.graded(_choices(spark, d), "text").select("event_id", "correct")


# ---------------------------------------------------------------- programs and short answers


@query("""WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, 'name = "' || p_name || '"' || chr(10) || 'print(name, ' || p_size || ')' AS code FROM part)
SELECT p_partkey, CASE WHEN k = 4 THEN code || chr(10) || 'print(2)' ELSE code END AS extracted FROM p""")
def programs_read(spark, d):
    """The code of a tagged block before an empty one, of a plain block, without fences, the last of two tagged blocks, and of an open end."""
    code = F.concat(F.lit('name = "'), "p_name", F.lit('"\nprint(name, '), F.col("p_size").cast("string"), F.lit(")"))
    shapes = [
        F.concat(F.lit("Try this:\n```python\n"), code, F.lit("\n```\nor\n```py\n\n```\n")), F.concat(F.lit("So\n```\n"), code, F.lit("\n```")), F.concat(F.lit("\n"), code, F.lit("\n\n")),
        F.concat(F.lit("```python\nprint(1)\n```\nbetter:\n``` py\n"), code, F.lit("\n```")), F.concat(F.lit("```Python\n"), code, F.lit("\nprint(2)\n``` and more")),
    ]
    rows = fx.read(spark, d, "part").select("p_partkey", F.lit("code").alias("task_type"), F.get(F.array(*shapes), (F.col("p_partkey") % 5).cast("int")).alias("text"))
    return tasks.extracted(rows, "text").select("p_partkey", "extracted")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, p_name AS n, p_brand AS b FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN n WHEN 1 THEN 'option ' || CASE WHEN p_partkey % 8 = 1 THEN 'b' ELSE 'a' END WHEN 2 THEN n || ' of ' || lower(replace(b, '#', '')) ELSE lower(split_part(n, ' ', 1)) END AS key FROM p""")
def short_keys(spark, d):
    """Reports by their words, options where the problem declares them, words where it does not."""
    k = F.col("p_partkey") % 4
    letter = F.when(F.col("p_partkey") % 8 == 1, "b").otherwise("a")
    rows = fx.read(spark, d, "part").select(
        "p_partkey",
        F.when(k == 0, "rag").when(k == 2, "subqa").otherwise("shortqa").alias("task_type"),
        F.when(k == 1, "Options: (A) nothing (B) all of it").otherwise("").alias("problem"),
        F.when(k == 0, F.concat(F.lit("Answer: The "), F.initcap("p_name"), F.lit(".")))
        .when(k == 1, F.concat(F.lit("It must be so.\nFinal answer: ("), letter, F.lit(").")))
        .when(k == 2, F.concat(F.lit("an "), "p_name", F.lit(", of the "), "p_brand"))
        .otherwise(F.concat(F.lit("Final answer: "), F.initcap(F.substring_index("p_name", " ", 1)), F.lit("."))).alias("text"),
    )
    return tasks.agreement_keys(rows, "text").select("p_partkey", "key")


# ---------------------------------------------------------------- turned conclusions


@query(r"""WITH n AS (SELECT o_orderkey, o_custkey % 90 + 10 AS g, o_orderkey % 60 + 2 AS x, 'We add what all of the ' || lower(substr(o_orderpriority, 3)) || ' orders bring, one after the other.' AS b FROM orders),
f AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 AND x <> g THEN CAST(x AS VARCHAR) ELSE CAST(g + greatest(1, CAST(round_even(g * 0.1, 0) AS BIGINT)) AS VARCHAR) END AS w FROM n)
SELECT o_orderkey, w AS forced, CASE WHEN o_orderkey % 2 = 0 THEN b || ' There are ' || x || ' of them.' ELSE b END || ' So \boxed{' || w || '} it is.' || chr(10) || chr(10) || 'Final answer: ' || w AS text FROM f""")
def turned_numbers(spark, d):
    """A number that the argument mentions, or the right one moved by a tenth, stands where the right one stood."""
    g, x = (F.col("o_custkey") % 90 + 10).cast("string"), (F.col("o_orderkey") % 60 + 2).cast("string")
    start = F.concat(F.lit("We add what all of the "), F.lower(F.substring("o_orderpriority", 3, 100)), F.lit(" orders bring, one after the other."))
    mention = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" There are "), x, F.lit(" of them."))).otherwise("")
    text = F.concat(start, mention, F.lit(" So \\boxed{"), g, F.lit("} it is.\n#### "), g, F.lit("\nFinal answer: "), g)
    rows = fx.read(spark, d, "orders").withColumn("t", prompts.turned(F.lit("math"), text, F.lit(None).cast("string"), g, text))
    return rows.select("o_orderkey", F.col("t.forced").alias("forced"), F.col("t.text").alias("text"))
