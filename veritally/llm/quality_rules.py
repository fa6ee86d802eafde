"""Quality rules by cross-document line frequency [native: built-in functions only].

Lines are normalised (lower case, digits as 0, runs of white space as one space, trimmed) and hashed with their host.
For each host the distinct documents with a line are counted (every row is a document, copies too; a line counts once in each); lines in
more than `max_documents` of them are removed from the text, and a document whose rest is too small is rejected. So documents that
a host has in more than `max_documents` exact copies lose all their lines, and none of them is kept.

Beside it stand five counts of the text itself, all in the row: no row leaves its task for them.

Defined results: a null or empty text has no words, so its counts are 0 and base_failed is true; a null source is the host
''; very long texts are read whole, row by row; a line of exactly `max_documents` documents stays; repeated rows (also of one doc_id) are documents of their own and are kept as often as they come; other columns are carried along, those with the names of results give way.
Hot lines and hot copies: counts are combined before the shuffle, and the verdicts are written once so that the join with
the documents is over two plain exchanges, whose hot partitions Spark splits at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, table


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def repeated_window_words(df: DataFrame, words: str, out: str, size: int = 5) -> DataFrame:
    """Add the number of words in windows of `size` words found twice or more in the list `words`.

    Windows are compared by 64-bit hash. Only rows where some window repeats are sorted.
    """
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn(
        "_g",
        F.when(F.size("_h") > size, F.transform(F.sequence(F.lit(0), F.size("_h") - size), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("_again", F.size(F.array_distinct("_g")) < F.size("_g"))
    df = df.withColumn("_s", F.when(F.col("_again"), F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    df = df.withColumn("_p", F.filter("_s", lambda x, i: x["g"].eqNullSafe(F.get("_s", i - 1)["g"]) | x["g"].eqNullSafe(F.get("_s", i + 1)["g"])))
    df = df.withColumn("_p", F.array_sort(F.transform("_p", lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(size), F.coalesce(F.get("_p", i + 1) - p, F.lit(size)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn(out, F.when(F.col("_again"), covered).otherwise(F.lit(0).cast("long"))).drop("_h", "_g", "_again", "_s", "_p")


def _chars(text: Column, dropped: str) -> Column:
    return F.length(F.translate(text, dropped, ""))


def base_counts(df: DataFrame, text: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_w", word_list(F.col(text)))
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": _chars(t, " \t\n\x0b\x0c\r").cast("long"),
            "n_symbols": (F.length(t) - _chars(t, "#*$%&|<>")).cast("long"),
            "_lines": F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0),
        }
    )
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    df = repeated_window_words(df, "_w", "n_repeat_words").drop("_w")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def normalised_lines(text: Column) -> Column:
    t = F.lower(F.translate(F.coalesce(text, F.lit("")), "123456789", "000000000"))
    lines = F.split(F.regexp_replace(t, r"[ \t\x0B\f\r]+", " "), "\n", -1)
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def shortened(docs: DataFrame, key: str, text: str, host: str, max_documents: int, min_words: int, max_removed: float) -> DataFrame:
    """The distinct keys whose text loses lines: n_removed_words, hashes of the lines removed (_gone), and whether it loses too
    much (_depleted): fewer than min_words words left, or over max_removed of them removed.

    A key must determine host and text.
    """
    lines = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(host), F.lit("")).alias("_host"), F.posexplode(normalised_lines(F.col(text))).alias("_n", "_line"))
    lines = lines.select("_k", "_n", F.xxhash64("_host", "_line").alias("_lh"), (F.length("_line") - F.length(F.translate("_line", " ", "")) + 1).alias("_words"))
    # a place of a text comes once for each document that has the text
    lines = lines.groupBy("_lh", "_k", "_n").agg(F.max("_words").alias("_words"), F.count("*").alias("_copies"))
    lines = table(lines.groupBy("_lh", "_k").agg(F.sum("_words").alias("_words"), F.max("_copies").alias("_copies")), "quality-lines")
    often = table(lines.groupBy("_lh").agg(F.sum("_copies").alias("_docs")).filter(F.col("_docs") > max_documents).select("_lh"), "quality-often")
    removed = lines.join(often, "_lh").groupBy("_k").agg(F.sum("_words").alias("_removed"), F.collect_list("_lh").alias("_gone"))
    total = lines.groupBy("_k").agg(F.sum("_words").alias("_total"))
    much = (F.col("_total") - F.col("_removed") < min_words) | (F.col("_removed") > max_removed * F.col("_total"))
    return table(removed.join(total, "_k").select(F.col("_k").alias(key), F.col("_removed").alias("n_removed_words"), "_gone", much.alias("_depleted")), "quality-shortened")


def without_lines(text: Column, host: Column, gone: Column) -> Column:
    """The text without the lines whose normalised form and host have one of the hashes."""
    lines = F.split(text, "\n", -1)

    def stays(line):
        plain = F.lower(F.translate(line, "123456789", "000000000"))
        plain = F.trim(F.regexp_replace(plain, r"[ \t\x0B\f\r]+", " "))
        return (plain == "") | ~F.array_contains(gone, F.xxhash64(F.coalesce(host, F.lit("")), plain))

    return F.when(gone.isNull(), text).otherwise(F.array_join(F.filter(lines, stays), "\n"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", max_documents: int = 50, min_words: int = 10, max_removed: float = 0.9) -> DataFrame:
    """Add the base counts, n_removed_words and kept to every row; the text is without the lines removed.

    The counts are of the text as it came.
    """
    keyed = docs.drop("n_removed_words", "kept").withColumn("_key", F.md5(F.concat(F.coalesce(F.col(host), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))))
    lost = shortened(keyed, "_key", text, host, max_documents, min_words, max_removed)
    joined = base_counts(keyed, text).join(lost, "_key", "left")
    joined = joined.withColumns(
        {
            text: without_lines(F.col(text), F.col(host), F.col("_gone")),
            "n_removed_words": F.coalesce("n_removed_words", F.lit(0)).cast("long"),
            "kept": ~F.col("base_failed") & ~F.coalesce("_depleted", F.lit(False)),
        }
    )
    return joined.drop("_key", "_gone", "_depleted")


PARAMETERS = {"max_documents": 50, "min_words": 10, "max_removed": 0.9}
COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality_rules(docs, **PARAMETERS).select(*COLUMNS)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT r, i, len(ws) AS n, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, sum(least(5, coalesce(nx - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM rep) GROUP BY r),
ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
base AS (
  SELECT d.r, d.doc_id, d.t, d.host, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) JOIN ln USING (r) LEFT JOIN cov USING (r)),
x AS (SELECT host, t, count(*) AS copies FROM d GROUP BY host, t),
xl AS (SELECT host, t, copies, trim(unnest(string_split(regexp_replace(lower(translate(t, '123456789', '000000000')), '[ \t\v\f\r]+', ' ', 'g'), chr(10)))) AS l FROM x),
yl AS (SELECT host, t, copies, l, len(string_split(l, ' ')) AS n FROM xl WHERE l <> ''),
often AS (SELECT host, l FROM (SELECT DISTINCT host, t, copies, l FROM yl) GROUP BY host, l HAVING sum(copies) > 50),
lost AS (SELECT yl.host, yl.t, sum(n) AS total, sum(CASE WHEN o.l IS NULL THEN 0 ELSE n END) AS removed FROM yl LEFT JOIN often o ON o.host = yl.host AND o.l = yl.l GROUP BY yl.host, yl.t),
bad AS (SELECT host, t FROM lost WHERE removed > 0 AND (total - removed < 10 OR removed > 0.9 * total))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND bad.t IS NULL AS kept
FROM base LEFT JOIN bad ON bad.host = base.host AND bad.t = base.t
"""
