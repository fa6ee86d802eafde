"""BM25 over a table of documents, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import places

#: Words that are not indexed, unless others are given.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves"
).split()


#: Query words that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 200_000


def sized(df: DataFrame, key: str, text: str, stopwords=STOPWORDS) -> DataFrame:
    """(key, size, words): the indexed words of each text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    rows = df.select(F.col(key), words.alias("words"))
    rows = rows.select(key, F.filter("words", lambda w: ~w.isin(list(stopwords))).alias("words"))
    return rows.select(key, F.size("words").alias("size"), "words")


def bm25(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", query: str = "item_id", text: str = "text", k1: float = 1.5, b: float = 0.75, digits: int = 4, stopwords=STOPWORDS) -> DataFrame:
    """(query, doc, score) of documents that share a word with the query: sum of weights times the query's word counts.

    Only words that some query has are kept before anything is counted or shuffled, so the work follows the queries.
    """
    rows = sized(docs, doc, text, stopwords)
    all_docs, total = rows.agg(F.count("*"), F.sum("size")).first()
    average = (total or 0) / max(1, all_docs)
    asked = sized(queries, query, text, stopwords).select(query, F.explode("words").alias("term")).groupBy(query, "term").agg(F.count("*").alias("times"))
    small = asked.count() <= MOST_BROADCAST
    send = F.broadcast if small else (lambda x: x)  # its rows bound those of the other tables sent
    wanted = send(asked.select("term").distinct())
    hits = rows.select(doc, "size", F.explode("words").alias("term")).join(wanted, "term").groupBy(doc, "size", "term").agg(F.count("*").alias("n"))
    df_ = hits.groupBy("term").agg(F.count("*").alias("df"))
    n, tf, length = F.lit(float(all_docs)), F.col("n").cast("double"), F.col("size").cast("double")
    idf = F.log(F.lit(1.0) + (n - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    weight = tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / F.lit(average or 1.0))) * idf
    scored = hits.join(send(df_), "term").withColumn("w", weight).select("term", doc, "w").join(send(asked), "term")
    # whole millionths add up alike in any order
    return scored.groupBy(query, doc).agg((F.sum(F.round(F.col("w") * F.col("times") * 1e6).cast("long")).cast("double") / F.lit(1e6)).alias("raw")).select(query, doc, places(F.col("raw"), digits).alias("score"))


def top(scores: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def recall(ranked: DataFrame, support: DataFrame, query: str, doc: str) -> DataFrame:
    """Queries, and those whose supporting document is among the ranked ones."""
    found = ranked.select(query, doc).join(support.select(query, doc), [query, doc], "left_semi").select(query).distinct()
    hit = support.select(query).distinct().join(found.withColumn("hit", F.lit(1)), query, "left")
    return hit.agg(F.count("*").alias("queries"), F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("found"))


#: Texts of fewer than three words have no word that a holder must have whole, and are looked for one by one: so many in a pass over the documents.
MOST_SHORT = 1_000


def holding(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, doc) of the documents whose text holds the item's text.

    A holder has each word of the item but the first and the last as a whole word, so only documents with the rarest of these
    are compared with the item: the work follows the rarest words, not documents times items. Items of fewer than three words are
    looked for in every document, `MOST_SHORT` in a pass.
    """
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    rows = items.filter(F.col(text).isNotNull()).select(F.col(item), F.col(text).alias("_item"), words(text).alias("_w"))
    inner = rows.filter(F.size("_w") > 2).select(item, F.explode(F.array_distinct(F.slice("_w", 2, F.size("_w") - 2))).alias("_term"))
    seen = docs.select(doc, F.explode(F.array_distinct(words(text))).alias("_term")).join(inner.select("_term").distinct(), "_term", "left_semi")
    often = seen.groupBy("_term").agg(F.count("*").alias("_df"))
    rarest = inner.join(often, "_term").groupBy(item).agg(F.min_by("_term", F.struct("_df", "_term")).alias("_term"))
    pairs = seen.join(rarest, "_term").select(item, doc)
    found = pairs.join(docs.select(doc, text), doc).join(rows.select(item, "_item"), item).filter(F.contains(text, "_item")).select(item, doc)
    short = rows.filter(F.size("_w") <= 2).select(item, "_item").distinct()
    passes = -(-short.count() // MOST_SHORT)
    for k in range(passes):
        some = short.filter(F.pmod(F.xxhash64(item, "_item"), F.lit(passes)) == k).collect()
        if some:
            each = F.array(*[F.when(F.contains(text, F.lit(r["_item"])), F.lit(r[item])) for r in some])
            found = found.union(docs.select(F.explode(F.array_compact(each)).alias(item), doc))
    return found.distinct()
