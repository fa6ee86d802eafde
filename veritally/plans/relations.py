"""Named queries of joins by time and interval, of numerics, sketches and table functions, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts, table_functions
from ..functions.maths import places
from ..operators import joins, numerics, sketches
from ..operators.asof import as_of
from ..operators.intervals import held_values, interval_join
from ..sources import feature_shards
from ..sources.stored import new_folder
from . import fixtures as fx
from .catalogue import _fl, query
from .fixtures import EV

# ---------------------------------------------------------------- as-of and interval joins

_HALF = "CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END"


def _keyed(spark, d):
    """Events by hour, half of them under one key."""
    return fx.read(spark, d, "events").select("event_id", "event_type", "value", F.expr(_HALF).alias("k"), F.date_trunc("hour", "ts").alias("hour"))


@query(f"""WITH e AS (SELECT event_id, event_type, value, {_HALF} AS k, date_trunc('hour', ts) AS hour FROM events),
r AS (SELECT k, hour, max(event_id) AS state_id, arg_max(value, event_id) AS state FROM e WHERE event_type IN ('purchase', 'signup') GROUP BY k, hour),
l AS (SELECT event_id, k, hour FROM e WHERE event_type NOT IN ('purchase', 'signup'))
SELECT event_id, a.state_id, {_fl('a.state')} AS state, b.state_id AS earlier_id FROM l ASOF LEFT JOIN r a ON l.k = a.k AND l.hour >= a.hour ASOF LEFT JOIN r b ON l.k = b.k AND l.hour > b.hour""")
def asof_state(spark, d):
    """The last purchase or signup of an event's key in its hour or before, and the last one before its hour."""
    rows = _keyed(spark, d)
    told = F.col("event_type").isin("purchase", "signup")
    states = rows.filter(told).select("k", "hour", F.col("event_id").alias("state_id"), F.col("value").alias("state"))
    out = as_of(rows.filter(~told).select("event_id", "k", "hour"), states, ["k"], "hour", ["state_id", "state"], last=["state_id"])
    out = as_of(out, states.select("k", "hour", F.col("state_id").alias("earlier_id")), ["k"], "hour", ["earlier_id"], last=["earlier_id"], strict=True)
    return out.select("event_id", "state_id", places(F.col("state"), 4).alias("state"), "earlier_id")


_SPAN = f"SELECT event_id, {_HALF} AS k, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + 60 * (1 + event_id % 50) * CASE WHEN event_id % 100 = 3 THEN 1000 ELSE 1 END AS b FROM events WHERE event_type IN ('purchase', 'signup')"
_POINT = f"SELECT event_id, {_HALF} AS k, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + 1 + 200 * (event_id % 7) AS b FROM events WHERE event_type NOT IN ('purchase', 'signup')"


def _spans(spark, d):
    """Spans that start at purchases and signups, one of a hundred of them a thousand times as long; and the other events as short ones."""
    rows = fx.read(spark, d, "events").select("event_id", "event_type", F.expr(_HALF).alias("k"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("a"))
    told = F.col("event_type").isin("purchase", "signup")
    length = 60 * (1 + F.col("event_id") % 50) * F.when(F.col("event_id") % 100 == 3, 1000).otherwise(1)
    short = 1 + 200 * (F.col("event_id") % 7)
    return rows.filter(~told).withColumn("b", F.col("a") + short).drop("event_type"), rows.filter(told).withColumn("b", F.col("a") + length).drop("event_type")


@query(f"""WITH s AS ({_SPAN}), p AS ({_POINT})
SELECT p.event_id, count(*) FILTER (WHERE p.b <= s.b AND p.a >= s.a) AS held, count(*) AS met, max(s.event_id) AS last FROM p JOIN s ON p.k = s.k AND p.a < s.b AND s.a < p.b GROUP BY p.event_id""")
def interval_overlaps(spark, d):
    """How many spans of its key an event overlaps, and how many hold it."""
    points, spans = _spans(spark, d)
    met = interval_join(points, spans.select("k", F.col("event_id").alias("span"), F.col("a").alias("c"), F.col("b").alias("d")), ["k"], ("a", "b"), ("c", "d"), "overlaps", 256)
    held = (F.col("a") >= F.col("c")) & (F.col("b") <= F.col("d"))
    return met.groupBy("event_id").agg(F.count(F.when(held, 1)).alias("held"), F.count("*").alias("met"), F.max("span").alias("last"))


@query(f"""WITH s AS ({_SPAN}), p AS ({_POINT}),
x AS (SELECT p.event_id, max(s.event_id) AS span FROM p JOIN s ON p.k = s.k AND p.a >= s.a AND p.b <= s.b AND s.event_id % 9 > 0 GROUP BY p.event_id)
SELECT p.event_id, CAST(coalesce(span % 9, 0) AS DOUBLE) AS value FROM p LEFT JOIN x ON x.event_id = p.event_id""")
def interval_values(spark, d):
    """The value of the last span that holds an event, as tokens get the values of the blocks that they lie in."""
    points, spans = _spans(spark, d)
    tokens = points.select("k", F.col("event_id").alias("token"), F.col("a").alias("start"), F.col("b").alias("end"))
    values = spans.select("k", F.col("event_id").alias("span"), F.col("a").alias("start"), F.col("b").alias("end"), (F.col("event_id") % 9).cast("double").alias("value"))
    return held_values(tokens, values, "k", 256).select(F.col("token").alias("event_id"), "value")


# ---------------------------------------------------------------- numerics


def _addresses(spark, d, numbers: int | None):
    rows = fx.read(spark, d, "embeddings").select((F.col("vec_id") % 4).alias("stream"), "vec_id", F.col("embedding").cast("array<double>").alias("address"), (F.col("label") % 3 == 0).cast("int").alias("label"))
    return rows if numbers is None else rows.withColumn("address", F.slice("address", 1, numbers))


@query(f"""WITH v AS (SELECT vec_id % 4 AS stream, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY vec_id % 4) AS n, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
s AS (SELECT stream, k, n, 100 + sum(x * x) OVER w AS a, sum(x * y) OVER w AS b, 100 + sum(y * y) OVER w AS c FROM v WINDOW w AS (PARTITION BY stream ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT stream, k AS writes, path, {_fl('2e0 / (a + c + sqrt((a - c) * (a - c) + 4e0 * b * b))', 9)} AS least_eigenvalue, {_fl('(a + c) / (a * c - b * b)', 9)} AS trace FROM s, (SELECT unnest(['short', 'symmetric', 'root']) AS path) WHERE k % 50 = 0 OR k = n""")
def covariance_of_two(spark, d):
    """The covariance of addresses of two numbers (all that the SQL can invert), as each path holds it."""
    out = numerics.covariance_report(_addresses(spark, d, 2), "stream", "vec_id", every=50)
    return out.select("stream", "writes", "path", places(F.col("least_eigenvalue"), 9).alias("least_eigenvalue"), places(F.col("trace"), 9).alias("trace"))


@query()
def covariance_drift(spark, d):
    """Drift, asymmetry and definiteness of each path over whole vectors."""
    return numerics.covariance_report(_addresses(spark, d, None), "stream", "vec_id", every=100)


# ---------------------------------------------------------------- stored features


@query(f"""WITH {EV} SELECT seq, CAST(id AS VARCHAR) AS id, task, {_fl('CAST(embedding[1] AS DOUBLE)')} AS question, {_fl('CAST(embedding[9] AS DOUBLE)')} AS meaning, {_fl('CAST(embedding[20] AS DOUBLE)')} AS answer FROM ev JOIN embeddings ON vec_id = seq WHERE seq >= 100""")
def feature_scan(spark, d):
    """Vectors written as feature shards, those from place 100 on read back (other shards are not opened) and joined with their events."""
    feature_shards.register(spark)
    ids = fx.events(spark, d).select("seq", F.col("id").cast("string").alias("id"))
    vectors = fx.read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("seq"), "embedding")
    part = lambda a, n: F.slice("embedding", a, n)
    features = vectors.join(ids, "seq").select("seq", "id", part(1, 8).alias("question"), part(9, 8).alias("meaning"), F.array(part(17, 4), part(21, 4)).alias("answers"), part(25, 2).alias("margins"))
    folder = new_folder(spark, "features")
    features.repartitionByRange(8, "seq").write.format("feature_shards").mode("append").save(folder)
    stored = spark.read.format("feature_shards").load(folder).filter("seq >= 100")
    stream = joins.feature_stream(stored, fx.events(spark, d))
    number = lambda c, n: places(F.get(c, n).cast("double"), 4)
    return stream.select("seq", "id", "task", number("question", 0).alias("question"), number("meaning", 0).alias("meaning"), number(F.get("answers", 0), 3).alias("answer"))


# ---------------------------------------------------------------- table functions

#: The lines of an order as the steps of a question: a relation of the part, then questions about earlier answers.
_STEPS = """SELECT CAST(l_orderkey AS {text}) AS question_id, l_linenumber AS step, CAST(l_partkey AS {text}) AS answer, CASE l_linenumber % 3 WHEN 1 THEN concat(' part ', CAST(l_partkey AS {text}), ' >> maker ')
  WHEN 2 THEN concat('Who sold #', CAST(l_linenumber - 1 AS {text}), ' of supplier ', CAST(l_suppkey AS {text}), '?') ELSE concat('Is #1 as large as #', CAST(l_linenumber - 1 AS {text}), '0 or #2?') END AS question FROM lineitem"""


@query(f"""WITH s AS (SELECT *, row_number() OVER w AS h, first_value(answer) OVER w AS one, nth_value(answer, 2) OVER (PARTITION BY question_id ORDER BY step, answer, question ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS two FROM ({_STEPS.format(text='VARCHAR')}) WINDOW w AS (PARTITION BY question_id ORDER BY step, answer, question)),
n AS (SELECT s.*, p.answer AS earlier FROM s LEFT JOIN s p ON p.question_id = s.question_id AND p.h = s.step - 1 AND p.h < s.h)
SELECT question_id || '/h' || h AS id, question_id, CAST(h AS INTEGER) AS sub_task, answer, CASE step % 3 WHEN 1 THEN 'What is the ''maker'' of ' || trim(split_part(question, '>>', 1)) || '?'
  WHEN 2 THEN CASE WHEN earlier IS NULL THEN question ELSE replace(question, '#' || (step - 1) || ' ', earlier || ' ') END
  ELSE replace(CASE WHEN h > 2 THEN replace(question, '#2?', two || '?') ELSE question END, '#1 ', CASE WHEN h > 1 THEN one ELSE '#1' END || ' ') END AS problem FROM n""")
def hops_in_sql(spark, d):
    """The hops of questions by a table function with PARTITION BY, from SQL."""
    table_functions.register(spark)
    fx.read(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(f"SELECT id, question_id, sub_task, answer, problem FROM question_hops(TABLE({_STEPS.format(text='STRING')}) PARTITION BY question_id ORDER BY (step, answer, question))")


_ASKED = "SELECT conv_id, min(CASE WHEN role = 'user' THEN text END) AS question, count(*) AS n FROM conversations GROUP BY conv_id"


@query(f"""WITH a AS ({_ASKED}), t AS (SELECT conv_id, list(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ORDER BY turn, text) AS ts FROM conversations GROUP BY conv_id),
j AS (SELECT a.conv_id, question, ts, unnest(range(len(ts))) AS slot FROM a JOIN t ON t.conv_id = a.conv_id)
SELECT conv_id, CAST(slot AS INTEGER) AS slot, md5('Question:' || chr(10) || trim(coalesce(question, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10) || chr(10) || 'Peer responses:' || chr(10) || chr(10) ||
  array_to_string(list_transform(ts, lambda x, k: 'Response ' || (k - 1) || CASE WHEN k - 1 = slot THEN ' [candidate under review]' ELSE '' END || ':' || chr(10) || x), chr(10) || chr(10)) || chr(10) || chr(10) ||
  'Candidate under review: Response ' || slot || chr(10) || chr(10) || 'Instruction:' || chr(10) || '{prompts.JUDGE}' || chr(10) || chr(10) || 'Answer:') AS prompt FROM j""")
def judge_prompts_in_sql(spark, d):
    """A judge's prompt for each turn of a conversation among its turns, by a lateral table function."""
    table_functions.register(spark)
    fx.read(spark, d, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(f"""WITH a AS ({_ASKED}), t AS (SELECT conv_id, transform(array_sort(collect_list(struct(turn, text))), x -> x.text) AS ts FROM conversations GROUP BY conv_id)
        SELECT a.conv_id, j.slot, md5(j.prompt) AS prompt FROM a JOIN t ON t.conv_id = a.conv_id, LATERAL judge_prompts(a.question, t.ts, CAST(NULL AS STRING)) j""")


# ---------------------------------------------------------------- sketches


@query("""SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS kinds, count(DISTINCT event_id) AS events FROM events GROUP BY event_type""")
def distinct_exact(spark, d):
    return fx.read(spark, d, "events").groupBy("event_type").agg(*[F.count_distinct(c).alias(n) for n, c in (("users", "user_id"), ("kinds", "props"), ("events", "event_id"))])


@query("""SELECT event_type, name, n AS exact, TRUE AS within, TRUE AS merged_as_one FROM (UNPIVOT (SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events FROM events GROUP BY event_type) ON users, events INTO NAME name VALUE n)""")
def distinct_sketch(spark, d):
    """Sketches of users and events by shard, merged: within four standard errors of the exact counts, and near the sketch of one pass."""
    rows = fx.read(spark, d, "events")
    out = None
    for name, column in (("users", "user_id"), ("events", "event_id")):
        parts = sketches.shard_sketches(rows, ["event_type"], F.col("event_id") % 16, column)
        found = sketches.estimated(sketches.merged(parts, ["event_type"]), "merged")
        one = rows.groupBy("event_type").agg(F.hll_sketch_agg(F.col(column), F.lit(sketches.LG)).alias("sketch"), F.count_distinct(column).alias("exact"))
        both = sketches.estimated(one, "one").join(found, "event_type")
        limit = F.lit(4 * sketches.error()) * F.col("exact") + 1
        both = both.select("event_type", F.lit(name).alias("name"), "exact", (F.abs(F.col("merged") - F.col("exact")) <= limit).alias("within"), (F.abs(F.col("merged") - F.col("one")) <= limit / 4).alias("merged_as_one"))
        out = both if out is None else out.unionByName(both)
    return out
