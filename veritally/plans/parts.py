"""Named queries over a record's parts: features, generations, flags, histories, verdicts, prompts, conclusions, graded tasks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as reading
from ..functions import prompts, symbolic, tasks
from ..functions import text as T
from ..functions.hashing import stable_fraction
from ..functions.maths import places
from ..operators import arbitration, blocked, joins, record
from . import fixtures as fx
from .catalogue import LN, _fl, query
from .fixtures import BR, EV, u

# ---------------------------------------------------------------- features and records

FS = f"{EV}, fs AS (SELECT ev.seq, ev.id, ev.task, embedding, vec_id FROM ev JOIN embeddings ON vec_id = seq)"


def _features(spark, d):
    """Vectors as the features of the events at their places, dealt to shards and back."""
    ids = fx.events(spark, d).select("seq", F.col("id").cast("string").alias("id"))
    vectors = fx.read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("seq"), "embedding")
    whole = vectors.join(ids, "seq")
    shards = [whole.filter(F.col("seq") % 3 == k) for k in (2, 0, 1)]
    return shards[0].unionByName(shards[1]).unionByName(shards[2])


@query(f"WITH {FS} SELECT seq, CAST(id AS VARCHAR) AS id, task, {_fl('CAST(embedding[1] AS DOUBLE)')} AS first FROM fs")
def feature_join(spark, d):
    stream = joins.feature_stream(_features(spark, d), fx.events(spark, d))
    return stream.select("seq", "id", "task", places(F.get("embedding", 0).cast("double"), 4).alias("first"))


@query(f"WITH {FS} SELECT seq // 7 AS pos, seq, CAST(id AS VARCHAR) AS id FROM fs WHERE seq % 7 = 3")
def feature_subset(spark, d):
    places_ = fx.events(spark, d).filter("seq % 7 = 3").select("seq", F.floor(F.col("seq") / 7).alias("pos"))
    return joins.subset(joins.feature_stream(_features(spark, d), fx.events(spark, d)), places_).select("pos", "seq", "id")


_REAL = f"CAST(floor({u(chr(39) + 'real|' + chr(39) + ' || id')} * 5e0) AS INTEGER)"


def _real(spark, d):
    return fx.events(spark, d).withColumn("real", F.floor(stable_fraction("real", F.col("id")) * 5).cast("int"))


@query(f"WITH {EV} SELECT id, seq, {_REAL} AS real FROM ev WHERE {_REAL} >= 1")
def consulted_events(spark, d):
    return joins.consulted_events(_real(spark, d)).select("id", "seq", "real")


@query()
def slot_permutation(spark, d):
    """The order in which each event's answers are shown; its shuffle is a generator's, which SQL has not."""
    rows = _real(spark, d).withColumn("real", F.when(F.col("real") > 0, F.col("real") + 2).otherwise(0))
    return joins.slot_permutation(rows, "seq", own=1, seed=3).select("seq", "id", "peer_order")


@query(f"WITH {EV}, l AS (SELECT id, seq, task, source, list(correct ORDER BY peer) AS c FROM (SELECT id, seq, task, source, peer, CAST({u(chr(39) + 'lab|' + chr(39) + ' || peer || ' + chr(39) + '|' + chr(39) + ' || id')} < CAST(3 + (peer + t) % 6 AS DOUBLE) / 10 AS INTEGER) AS correct FROM ev, (SELECT unnest(range(0, 6)) AS peer)) GROUP BY ALL) SELECT seq AS pos, CAST(id AS VARCHAR) AS id, task AS task_type, CAST(source AS VARCHAR) AS source, array_to_string(c, ',') AS labels FROM l WHERE seq < 700")
def no_record_rows(spark, d):
    soft = fx.answers(spark, d).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("peer").cast("string").alias("peer"), (F.col("correct") * 0.75).cast("double").alias("y"))))).alias("peer_correct"))
    rows = fx.events(spark, d).join(soft, "id").withColumns({"correctness_by_peer": F.lit(None).cast("map<string,int>"), "task_type": F.col("task"), "source": F.col("source").cast("string")})
    out = joins.no_record_rows(rows, rows.select("seq", F.col("seq").alias("pos")), 700)
    return out.select("pos", "id", "task_type", "source", F.array_join(F.transform("peer_correct", lambda x: x.cast("string")), ",").alias("labels"))


_DIM = 3


def _record_sql(dim: int, keep: float | None = None) -> str:
    """The posterior along each stream of vectors by a recursive query, by Gauss elimination of the small system; with forgetting if asked."""
    n = dim + 1
    x = [f"coalesce(CAST(embedding[{k + 1}] AS DOUBLE), 0)" for k in range(dim)] + ["1e0"]
    state = ", ".join([f"a{i}{j}" for i in range(n) for j in range(i, n)] + [f"b{i}" for i in range(n)])
    zero = ", ".join(["100e0" if i == j else "0e0" for i in range(n) for j in range(i, n)] + ["0e0"] * n)
    now = ", ".join([f"a{i}{j} + x{i} * x{j}" for i in range(n) for j in range(i, n)] + [f"b{i} + x{i} * y" for i in range(n)])
    if keep is not None:
        prior = lambda i, j: f" + {(1 - keep) * 100!r}" if i == j else ""
        now = ", ".join([f"{keep!r} * a{i}{j}{prior(i, j)} + x{i} * x{j}" for i in range(n) for j in range(i, n)] + [f"{keep!r} * b{i} + x{i} * y" for i in range(n)])
    # elimination, written out
    m = {(i, j): f"a{min(i, j)}{max(i, j)}" for i in range(n) for j in range(n)}
    rhs = {(i, 0): f"b{i}" for i in range(n)} | {(i, 1): f"x{i}" for i in range(n)}
    steps = []
    for k in range(n):
        names = []
        for i in range(k + 1, n):
            f = f"({m[i, k]} / {m[k, k]})"
            for j in range(k + 1, n):
                names.append((f"m{k}_{i}{j}", f"{m[i, j]} - {f} * {m[k, j]}"))
            for c in (0, 1):
                names.append((f"r{k}_{i}{c}", f"{rhs[i, c]} - {f} * {rhs[k, c]}"))
        if names:
            steps.append(", ".join(f"{e} AS {a}" for a, e in names))
        for i in range(k + 1, n):
            for j in range(k + 1, n):
                m[i, j] = f"m{k}_{i}{j}"
            for c in (0, 1):
                rhs[i, c] = f"r{k}_{i}{c}"
    # forward substitution suffices: b' A^-1 x and x' A^-1 x are sums over pivots
    dot = lambda c: " + ".join(f"{rhs[i, c]} * {rhs[i, 1]} / {m[i, i]}" for i in range(n))
    inner = f"SELECT *, {steps[0]} FROM w"
    for s in steps[1:]:
        inner = f"SELECT *, {s} FROM ({inner})"
    return f"""WITH RECURSIVE v AS (SELECT vec_id, vec_id % 4 AS stream, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) AS k, {', '.join(f'{e} AS x{i}' for i, e in enumerate(x))}, CASE WHEN label % 3 = 0 THEN 1e0 ELSE -1e0 END AS y FROM embeddings),
st AS (SELECT DISTINCT stream, CAST(0 AS BIGINT) AS k, {', '.join(f'{z} AS {s}' for z, s in zip(zero.split(', '), state.split(', '), strict=True))} FROM v
  UNION ALL SELECT st.stream, v.k, {now} FROM st JOIN v ON v.stream = st.stream AND v.k = st.k + 1),
w AS (SELECT v.*, {state} FROM st JOIN v ON v.stream = st.stream AND v.k = st.k + 1)
SELECT vec_id, {_fl(dot(0), 6)} AS mean, {_fl(dot(1), 6)} AS variance FROM ({inner})"""


@query(_record_sql(_DIM))
def record_of_three(spark, d):
    rows = fx.read(spark, d, "embeddings").withColumn("stream", F.col("vec_id") % 4)
    rows = rows.select("stream", F.col("vec_id"), F.transform(F.slice("embedding", 1, _DIM), lambda x: x.cast("double")).alias("address"), F.array((F.col("label") % 3 == 0).cast("int")).alias("labels"))
    out = record.fold(rows, "stream", "vec_id")
    return out.select("vec_id", places(F.get("mean", 0), 6).alias("mean"), places(F.col("variance"), 6).alias("variance"))


def _vectors(spark, d):
    """Streams of the first numbers of vectors, each with a label."""
    rows = fx.read(spark, d, "embeddings").withColumn("stream", F.col("vec_id") % 4)
    return rows.select("stream", F.col("vec_id"), F.transform(F.slice("embedding", 1, _DIM), lambda x: x.cast("double")).alias("address"), F.array((F.col("label") % 3 == 0).cast("int")).alias("labels"))


def _means(out):
    return out.select("vec_id", places(F.get("mean", 0), 6).alias("mean"), places(F.col("variance"), 6).alias("variance"))


@query(_record_sql(_DIM))
def record_in_blocks(spark, d):
    return _means(blocked.fold_in_blocks(_vectors(spark, d), "stream", "vec_id", block=50))


@query(_record_sql(_DIM, 0.97))
def forgetting_of_three(spark, d):
    return _means(record.fold(_vectors(spark, d), "stream", "vec_id", keep=0.97))


@query(_record_sql(_DIM, 0.97))
def forgetting_in_blocks(spark, d):
    return _means(blocked.fold_in_blocks(_vectors(spark, d), "stream", "vec_id", keep=0.97, block=50))


_X = [f"coalesce(CAST(embedding[{k + 1}] AS DOUBLE), 0)" for k in range(_DIM)] + ["1e0"]


@query(f"""WITH RECURSIVE v AS (SELECT vec_id, vec_id % 4 AS stream, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) AS k, {', '.join(f'{e} AS x{i}' for i, e in enumerate(_X))}, CASE WHEN label % 3 = 0 THEN 1e0 ELSE -1e0 END AS y FROM embeddings),
st AS (SELECT DISTINCT stream, CAST(0 AS BIGINT) AS k, 0e0 AS w0, 0e0 AS w1, 0e0 AS w2, 0e0 AS w3 FROM v
  UNION ALL SELECT st.stream, v.k, {', '.join(f'w{i} + 0.05e0 / (x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3 + 1e-12) * (y - (w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3)) * x{i}' for i in range(4))} FROM st JOIN v ON v.stream = st.stream AND v.k = st.k + 1)
SELECT vec_id, {_fl('w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3', 6)} AS mean FROM st JOIN v ON v.stream = st.stream AND v.k = st.k + 1""")
def delta_of_three(spark, d):
    rows = fx.read(spark, d, "embeddings").withColumn("stream", F.col("vec_id") % 4)
    rows = rows.select("stream", F.col("vec_id"), F.transform(F.slice("embedding", 1, _DIM), lambda x: x.cast("double")).alias("address"), F.array((F.col("label") % 3 == 0).cast("int")).alias("labels"))
    return record.fold(rows, "stream", "vec_id", rule="delta").select("vec_id", places(F.get("mean", 0), 6).alias("mean"))


@query()
def record_from_features(spark, d):
    """A record by the design qc along the events that have features; answers' parts are slices of the event's vector."""
    stream = joins.feature_stream(_features(spark, d), fx.events(spark, d)).select("seq", "id", "embedding")
    labels = fx.answers(spark, d).groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("peer", "correct"))), lambda x: x["correct"]).alias("labels"))
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    rows = stream.join(labels, "seq").select(F.lit(0).alias("run"), F.col("seq").alias("pos"), "id", part(1, 4).alias("q"), F.array(*[part(1 + 4 * p, 4) for p in range(fx.PEERS)]).alias("c"), F.array(*[F.lit(0.0)] * fx.PEERS).alias("margins"), (1 + F.col("seq") % fx.PEERS).cast("int").alias("real"), "labels")
    return record.record_walk(rows, "run", fx.PEERS)


# ---------------------------------------------------------------- generations, flags, histories, verdicts

def _generations(spark, d):
    """Two tables of the model's answers, each without a tenth of the events."""
    rows = fx.branches(spark, d)
    g = lambda name, c: rows.filter(stable_fraction(name, F.col("id")) >= 0.1).select("id", F.col(c).alias("correct"), F.concat(F.lit(f"{name} "), F.col("id").cast("string")).alias("generation"))
    return rows, g("pmg", "read_correct"), g("qag", "alone_correct")


_GEN = f"{BR}, g AS (SELECT br.*, {u(chr(39) + 'pmg|' + chr(39) + ' || id')} >= 0.1e0 AS has_read, {u(chr(39) + 'qag|' + chr(39) + ' || id')} >= 0.1e0 AS has_alone FROM br)"


@query(f"WITH {_GEN} SELECT CAST(id AS VARCHAR) AS id, read_correct, alone_correct, 'pmg ' || id AS read_generation, 'qag ' || id AS alone_generation FROM g WHERE has_read AND has_alone")
def generations_joined(spark, d):
    rows, read, alone = _generations(spark, d)
    return joins.with_generations(rows.select("id", "seq"), read, alone, skip_missing=True).select("id", "read_correct", "alone_correct", "read_generation", "alone_generation")


@query(f"WITH {_GEN} SELECT task, count(*) AS skipped FROM g WHERE NOT (has_read AND has_alone) GROUP BY task")
def generations_missing(spark, d):
    rows, read, alone = _generations(spark, d)
    return joins.without_generations(rows.select("id", "task"), read, alone).groupBy("task").agg(F.count("*").alias("skipped"))


@query(f"WITH {EV}, f AS (SELECT id, seq, [{', '.join(f'''{u(f"'flag|{p}|' || id")} < 0.3e0''' for p in range(4))}] AS flags FROM ev WHERE seq % 5 <> 0) SELECT id, array_to_string(list_transform([2, 0, 3], lambda p: CASE WHEN flags[p + 1] THEN '1' ELSE '0' END), '') AS shown FROM f")
def flags_in_order(spark, d):
    events = fx.events(spark, d)
    flags = events.filter("seq % 5 <> 0").select("id", F.array(*[stable_fraction("flag", F.lit(p), F.col("id")) < 0.3 for p in range(4)]).alias("flags"))
    rows = joins.with_flags(events.select("id", F.array(F.lit(2), F.lit(0), F.lit(3)).alias("peer_order")), flags)
    return rows.select("id", F.array_join(F.transform("misled", lambda x: F.when(x, "1").otherwise("0")), "").alias("shown"))


@query(f"WITH {EV} SELECT id, 'a' || id || '|b' || id AS history FROM ev")
def debate_history(spark, d):
    events = fx.events(spark, d)
    before = events.select("id", F.lit("x").alias("generation"), F.array(F.concat(F.lit("a"), F.col("id").cast("string")), F.concat(F.lit("b"), F.col("id").cast("string"))).alias("history"))
    return joins.with_history(events.select("id"), before, 2).select("id", F.array_join("history", "|").alias("history"))


_REJ = u("'rej|' || s || '|' || id")


@query(f"WITH {EV} SELECT id, CAST(s AS INTEGER) AS source, CAST({_REJ} < 0.4e0 AS INTEGER) AS rejected FROM ev, (SELECT unnest(range(0, 3)) AS s)")
def verdict_rejections(spark, d):
    events = fx.events(spark, d)
    said = events.select("id", F.array(*[F.when(stable_fraction("rej", F.lit(s), F.col("id")) < 0.4, "REJECT").otherwise("ACCEPT") for s in range(4)]).alias("verdicts"))
    return joins.rejections(events, said, 3)


@query("SELECT CAST(n_nationkey AS INTEGER) AS idx, n_name AS tag, r_name AS model, CASE WHEN n_nationkey % 3 = 0 THEN 'own' ELSE left(r_name, 2) END AS engine, length(r_name) AS size FROM nation JOIN region ON r_regionkey = n_regionkey")
def described_peers(spark, d):
    models = fx.read(spark, d, "region").select(F.col("r_name").alias("model"), F.substring("r_name", 1, 2).alias("engine"), F.length("r_name").cast("long").alias("size"), "r_regionkey")
    peers = fx.read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("index"), F.col("n_name").alias("tag"), "n_regionkey", F.when(F.col("n_nationkey") % 3 == 0, "own").alias("engine"))
    peers = peers.join(models.select("r_regionkey", "model"), F.col("r_regionkey") == F.col("n_regionkey")).select("index", "tag", "model", "engine")
    return joins.described_peers(peers, models.drop("r_regionkey")).select(F.col("index").alias("idx"), "tag", "model", "engine", "size")


@query(f"WITH {EV} SELECT source, count(*) AS events, count(*) FILTER (id % 4 IN (1, 2)) AS reads FROM ev WHERE source IN (2, 5) GROUP BY source")
def source_choices(spark, d):
    said = F.element_at(F.array(F.lit("No consultation"), F.lit("Advisors + MEMORY"), F.lit("peers first"), F.lit(None)), (F.col("id") % 4 + 1).cast("int"))
    rows = joins.from_sources(fx.events(spark, d).withColumn("source", F.col("source").cast("string")), ["2", "5"])
    return rows.groupBy(F.col("source").cast("long").alias("source")).agg(F.count("*").alias("events"), F.sum(joins.chose_to_read(said).cast("int")).cast("long").alias("reads"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 64 AS BIGINT) AS batch FROM documents")
def length_batches(spark, d):
    return joins.length_batches(fx.read(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 64, "doc_id").select("doc_id", "batch")


@query("SELECT n_nationkey AS k, array_to_string(list_sort(list_distinct([greatest(1, (n_nationkey + 2) // 3), greatest(1, 2 * (n_nationkey + 2) // 3), n_nationkey + 1])), ',') AS layers FROM nation")
def chosen_layers(spark, d):
    return fx.read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.array_join(F.transform(joins.chosen_layers(F.col("n_nationkey") + 2), lambda x: x.cast("string")), ",").alias("layers"))


# ---------------------------------------------------------------- prompts, blocks, conclusions

_TASKS = ["math", "rag", "boolqa", "mcqa", "shortqa", "code", "subqa", "code"]


def _lit(text: str) -> str:
    """A text as SQL."""
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in text.split("\n"))


_PASS = "left('[1] ' || text || chr(10) || '[2] ' || lang, 8000)"


@query(f"""SELECT doc_id, md5(CASE doc_id % 8 WHEN 0 THEN {_lit(prompts.MATH)} || q WHEN 4 THEN {_lit(prompts.SHORT)} || q WHEN 5 THEN {_lit(prompts.PROGRAM)} || q WHEN 7 THEN {_lit(prompts.FUNCTION)} || q
  WHEN 2 THEN {_lit(prompts.YES_NO)} || {_lit(chr(10) * 2 + 'Passage:' + chr(10))} || p || {_lit(chr(10) * 2 + 'Question: ')} || q
  WHEN 3 THEN {_lit(prompts.CHOICE)} || q || {_lit(chr(10) * 2 + 'Options:' + chr(10))} || '(A) ' || lang || chr(10) || '(B) ' || source
  ELSE {_lit(prompts.RETRIEVED)} || p || {_lit(chr(10) * 2 + 'Question: ')} || q || {_lit(chr(10) + 'Answer:')} END) AS prompt FROM (SELECT *, 'Why ' || source || '?' AS q, {_PASS} AS p FROM documents)""")
def peer_prompts(spark, d):
    rows = fx.read(spark, d, "documents")
    task = F.get(F.array(*[F.lit(t) for t in _TASKS]), (F.col("doc_id") % 8).cast("int"))
    form = F.when(F.col("doc_id") % 8 == 5, "io").otherwise("call")
    out = prompts.peer_prompt(task, F.concat(F.lit("Why "), "source", F.lit("?")), F.array("text", "lang"), F.array("lang", "source"), F.lit(None).cast("array<string>"), form)
    return rows.select("doc_id", F.md5(out).alias("prompt"))


_W = "' ' || chr(10) || chr(9) || chr(13)"


@query(f"""WITH t AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS ts, CAST(count(*) AS INTEGER) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id), c AS (SELECT *, unnest(range(0, n)) AS k FROM t)
SELECT conv_id, CAST(k AS INTEGER) AS candidate, md5({_lit('Question:' + chr(10))} || conv_id || {_lit(chr(10) * 2 + 'Peer responses:' + chr(10) * 2)} || array_to_string(list_transform(ts, lambda x, i: 'Response ' || (i - 1) || CASE WHEN i - 1 = k THEN ' [candidate under review]' ELSE '' END || ':' || chr(10) || trim(x, {_W})), chr(10) || chr(10))
  || {_lit(chr(10) * 2 + 'Candidate under review: Response ')} || k || {_lit(chr(10) * 2 + 'Instruction:' + chr(10) + prompts.JUDGE + chr(10) * 2 + 'Answer:')}) AS prompt FROM c""")
def judge_prompts(spark, d):
    said = fx.read(spark, d, "conversations").filter("role = 'assistant'")
    texts = said.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("ts"))
    rows = texts.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.size("ts") - 1)))
    return rows.select("conv_id", "candidate", F.md5(prompts.judge_prompt(F.col("conv_id").cast("string"), F.col("ts"), F.col("candidate"))).alias("prompt"))


@query(f"SELECT conv_id, turn, md5('Check it.' || {_lit(chr(10) * 2 + 'Sub-question: ')} || role || {_lit(chr(10) * 2 + chr(87) + 'orker' + chr(39) + 's answer:' + chr(10))} || left(trim(coalesce(text, ''), {_W}), 1500)) AS prompt FROM conversations")
def check_prompts(spark, d):
    return fx.read(spark, d, "conversations").select("conv_id", "turn", F.md5(prompts.check_prompt(F.lit("Check it."), F.col("role"), F.col("text"))).alias("prompt"))


_BLK = "CASE WHEN length(b) <= 50 THEN b ELSE rtrim(left(b, 50), ' ' || chr(10) || chr(9)) || ' ...' END"


@query(f"""WITH x AS (SELECT event_id AS id, ['one ' || event_id || ' ' || repeat('z', 60), '', 'three ' || event_type] AS ts FROM events), c AS (SELECT id, unnest(ts) AS b, generate_subscripts(ts, 1) AS k FROM x), y AS (SELECT id, k, {_BLK} AS b FROM c),
z AS (SELECT id, k, b, sum(length('Peer ' || k || ':' || chr(10)) + length(b) + 2) OVER (PARTITION BY id ORDER BY k) AS e FROM y)
SELECT id, CAST(k AS INTEGER) AS k, CAST(CASE WHEN b = '' THEN 0 ELSE 6 + e - 2 - length(b) END AS INTEGER) AS start, CAST(CASE WHEN b = '' THEN 0 ELSE 6 + e - 2 END AS INTEGER) AS stop FROM z""")
def block_spans(spark, d):
    events = fx.read(spark, d, "events").select(F.col("event_id").alias("id"), F.array(F.concat(F.lit("one "), F.col("event_id").cast("string"), F.lit(" " + "z" * 60)), F.lit(""), F.concat(F.lit("three "), "event_type")).alias("ts"))
    shown = F.array_join(F.transform("ts", lambda t, i: F.concat(F.lit("Peer "), (i + 1).cast("string"), F.lit(":\n"), T.clip(t, 50))), "\n\n")
    spans = prompts.block_spans(F.col("ts"), F.concat(F.lit("Read:\n"), shown, F.lit("\n\nAnswer now.")), 50)
    rows = events.select("id", F.posexplode(spans).alias("k", "s"))
    return rows.select("id", (F.col("k") + 1).alias("k"), F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query("""WITH t AS (SELECT event_id AS id, unnest(range(0, 6)) AS token FROM events), s AS (SELECT event_id AS id, event_id % 7 AS a FROM events)
SELECT t.id, t.token, CASE WHEN token * 3 >= a AND token * 3 + 2 <= a + 6 AND a % 5 <> 0 THEN CAST(a AS DOUBLE) / 4 ELSE 0e0 END AS value FROM t JOIN s USING (id)""")
def token_values(spark, d):
    ids = fx.read(spark, d, "events").select(F.col("event_id").alias("id"))
    tokens = ids.withColumn("token", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>"))).withColumns({"start": F.col("token") * 3, "end": F.col("token") * 3 + 2})
    a = F.col("id") % 7
    spans = ids.select("id", F.lit(0).alias("span"), a.alias("start"), (a + 6).alias("end"), F.when(a % 5 == 0, 0.0).otherwise(a.cast("double") / 4).alias("value"))
    return joins.token_values(tokens, spans).select("id", "token", "value")


_TURN = "'This is an argument of enough length about ' || task || '.' || chr(10)"


@query(f"""WITH {EV}, x AS (SELECT id, id % 4 AS k, {_TURN} AS b FROM ev) SELECT id, md5(CASE k WHEN 0 THEN rtrim(b, chr(10)) || {_lit(chr(10) * 2 + 'Final answer: (C)')} WHEN 1 THEN rtrim(b, chr(10)) || {_lit(chr(10) * 2 + 'Final answer: no')}
  WHEN 2 THEN b || 'Take 17 and \\boxed{{17}} here.' || {_lit(chr(10) * 2 + 'Final answer: 17')} ELSE b || 'Answer: x' END) AS text, CASE k WHEN 0 THEN 'C' WHEN 1 THEN 'no' WHEN 2 THEN '17' END AS forced FROM x""")
def turned_conclusions(spark, d):
    k = F.col("id") % 4
    start = F.concat(F.lit("This is an argument of enough length about "), "task", F.lit(".\n"))
    said = F.concat(start, F.when(k == 0, "Final answer: (B)").when(k == 1, "Answer: yes").when(k == 2, "Take 17 and \\boxed{42} here.\n#### 42\nFinal answer: 42").otherwise("Answer: x"))
    task = F.when(k == 0, "mcqa").when(k == 1, "boolqa").when(k == 2, "math").otherwise("rag")
    wrong = F.when(k == 0, "C").when(k == 1, "no")
    rows = fx.events(spark, d).withColumn("t", prompts.turned(task, said, wrong, F.lit("42"), F.col("task")))
    return rows.select("id", F.md5("t.text").alias("text"), F.col("t.forced").alias("forced"))


# ---------------------------------------------------------------- graded tasks: cases of all types, joined by their number

_CASES = [
    # task, answer, choices, problem, stored, text, correct, extracted, key
    ("math", "0.5", None, "", None, "so \\boxed{\\frac{1}{2}}", 1, "1/2", None),
    ("math", "7", None, "", None, "I get 8", 0, "iget8", None),
    ("math", "1,200", None, "", None, "### Final Answer\nIt is $1200$ in all.", 1, "1200", None),
    ("math", "x_5", None, "", None, "The answer is: $x_{5}$", 1, "x_5", None),
    ("math", "3/4", None, "", None, "Final answer:\n\\[ \\dfrac{3}{4} \\]\n", 1, "3/4", None),
    ("rag", "the Seine", None, "", None, "Answer: Seine River.", 1, "Seine River", "seine river"),
    ("rag", "Rome", None, "", None, "Answer: near Paris", 0, "near Paris", "near paris"),
    ("boolqa", "yes", None, "", None, "<think>no</think> Final answer: TRUE", 1, "yes", "yes"),
    ("boolqa", "no", None, "", None, "yes", 0, "yes", "yes"),
    ("mcqa", "(B)", ["x", "y"], "", None, "Final answer: B", 1, "B", "b"),
    ("mcqa", "A", ["x", "y"], "", None, "I choose (B)\nor the answer is (A)", 1, "(A)", "a"),
    ("shortqa", "(A)", None, "Options: (A) x (B) y", None, "Final answer: (a).", 0, "(a)", "option a"),
    ("shortqa", "invalid", None, "", None, "Final answer: Invalid.", 1, "Invalid", "invalid"),
    ("subqa", "Oslo", None, "", None, "It is the city of Oslo in Norway", 1, "It is the city of Oslo in Norway", "it is city of oslo in norway"),
    ("code", "", None, "", 1.0, "```python\nprint(1)\n```", 1, "print(1)", None),
    ("code", "", None, "", None, "print(1)", 0, "print(1)", None),
]


def _q(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


_EXPECTED = ", ".join(f"({k}, {c[6]}, {_q(c[7])}, {_q(c[8])})" for k, c in enumerate(_CASES))


def _cases(spark, d):
    """Every event with the case of its number."""
    literal = lambda v, kind: F.lit(v).cast(kind) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v])
    kinds = (("task_type", "string"), ("answer", "string"), ("choices", "array<string>"), ("problem", "string"), ("stored", "double"), ("text", "string"))
    every = F.array(*[F.struct(*[literal(c[n], k).alias(name) for n, (name, k) in enumerate(kinds)]) for c in _CASES])
    rows = fx.events(spark, d).select("id", F.get(every, (F.col("id") % len(_CASES)).cast("int")).alias("c"))
    return rows.select("id", "c.*")


@query(f"SELECT event_id AS id, CAST(correct AS INTEGER) AS correct FROM events JOIN (VALUES {_EXPECTED}) AS e(k, correct, extracted, key) ON k = event_id % {len(_CASES)}")
def mixed_grading(spark, d):
    return tasks.graded(_cases(spark, d), "text", "stored").select("id", "correct")


@query(f"SELECT event_id AS id, extracted FROM events JOIN (VALUES {_EXPECTED}) AS e(k, correct, extracted, key) ON k = event_id % {len(_CASES)}")
def mixed_extraction(spark, d):
    rows = _cases(spark, d).withColumn("text", T.without_thinking(F.col("text")))
    return tasks.extracted(rows, "text").select("id", "extracted")


@query(f"SELECT event_id AS id, key FROM events JOIN (VALUES {_EXPECTED}) AS e(k, correct, extracted, key) ON k = event_id % {len(_CASES)}")
def mixed_keys(spark, d):
    rows = _cases(spark, d).withColumn("text", T.without_thinking(F.col("text")))
    return tasks.agreement_keys(rows, "text").select("id", "key")


_MATHS = [("\\boxed{\\frac{\\sqrt{3}}{3}}", "\\frac{\\sqrt3}{3}"), ("#### 1,234", "1234"), ("The answer is 5.4 \\text{ cents}", "5.4"), ("(-1, 6)", "(-1,6)"), ("30^\\circ", "30"), ("I get 42 after all that work", "42"), ("\\text{No solution}", "nosolution"), ("25\\%", "25"), ("so \\frac{3}{4} it is, in the end", "3/4")]


@query(f"SELECT event_id AS id, answer FROM events JOIN (VALUES {', '.join(f'({k}, {_q(a)})' for k, (_, a) in enumerate(_MATHS))}) AS e(k, answer) ON k = event_id % {len(_MATHS)}")
def stated_answers(spark, d):
    said = F.get(F.array(*[F.lit(t) for t, _ in _MATHS]), (F.col("id") % len(_MATHS)).cast("int"))
    return fx.events(spark, d).select("id", reading.final_answer_udf(said).alias("answer"))


_EQUAL = [("\\frac{1}{2}", "0.5", True), ("1/3", "0.3", False), ("", "1", False), ("1000", "1,000", True), ("3.14159", "3.1416", True), ("2e3", "2000", True), ("1e99999", "1e99998", False)]


@query(f"SELECT event_id AS id, same FROM events JOIN (VALUES {', '.join(f'({k}, {s})' for k, (*_, s) in enumerate(_EQUAL))}) AS e(k, same) ON k = event_id % {len(_EQUAL)}")
def equal_answers(spark, d):
    side = lambda n: F.get(F.array(*[F.lit(c[n]) for c in _EQUAL]), (F.col("id") % len(_EQUAL)).cast("int"))
    return fx.events(spark, d).select("id", reading.math_equal_udf(side(0), side(1)).alias("same"))


_OPTIONS = [("I pick (B).\nFinal answer: (C)", "C"), ("option b", "B"), ("", ""), ("the letter: D", "D"), ("a", "A"), ("(A) or (B)?\nI select C", "C")]


@query(f"SELECT event_id AS id, picked FROM events JOIN (VALUES {', '.join(f'({k}, {_q(a)})' for k, (_, a) in enumerate(_OPTIONS))}) AS e(k, picked) ON k = event_id % {len(_OPTIONS)}")
def picked_options(spark, d):
    said = F.get(F.array(*[F.lit(t) for t, _ in _OPTIONS]), (F.col("id") % len(_OPTIONS)).cast("int"))
    return fx.events(spark, d).select("id", reading.option_udf(said, F.array(*[F.lit(x) for x in "ABCD"])).alias("picked"))

# ---------------------------------------------------------------- symbolic answers


@query("""WITH n AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderkey % 13 - 6 AS q, o_custkey % 7 - 3 AS r, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 4 ELSE 0 END AS e FROM orders)
SELECT o_orderkey, CASE WHEN k = 2 THEN list_sort(list_distinct([q, r])) = list_sort(list_distinct([r + e, q])) ELSE e = 0 END AS same FROM n""")
def symbolic_equal(spark, d):
    """Two answers made from the numbers of each order: a product and a polynomial, sums of fractions, sets, intervals,
    equations, roots. They mean the same but for e, which is 0 for most."""
    n = fx.read(spark, d, "orders").selectExpr("o_orderkey", "o_orderkey % 6 AS k", "o_custkey % 9 + 1 AS p", "o_orderkey % 13 - 6 AS q", "o_custkey % 7 - 3 AS r", "o_orderkey % 5 + 2 AS s", "IF(o_custkey % 3 = 0, o_orderkey % 4, 0) AS e")
    said = lambda form, *numbers: F.format_string(form, *[F.expr(x).cast("long") for x in numbers])
    shapes = [
        (said("(%dx + %d)(%d - x)", "p", "q", "s"), said("-%dx^2 + (%d)x + %d", "p", "p * s - q + e", "q * s")),
        (said(r"\frac{%d}{%d} + \frac{%d}{%d}", "q", "p", "r", "s"), said(r"$\dfrac{%d}{%d}$", "q * s + r * p + e", "p * s")),
        (said("x = %d or x = %d", "q", "r"), said(r"\{%d, %d\}", "r + e", "q")),
        (said("[%d, %d)", "r", "r + s"), said(r"\left[%d - %d, \frac{%d}{%d}\right)", "r + e", "e * 2", "(r + s) * p", "p")),
        (said("%dy - %dx = %d", "p", "q", "r"), said("%dy = 2(%dx) + %d", "2 * p", "q", "2 * r + e")),
        (said(r"\sqrt{%d}", "s * s * p"), said(r"%d\sqrt{%d} + %d", "s", "p", "e")),
    ]
    side = lambda n: F.get(F.array(*[x[n] for x in shapes]), F.col("k").cast("int"))
    return n.select("o_orderkey", symbolic.symbolic_equal_udf(side(0), side(1)).alias("same"))


# ---------------------------------------------------------------- relational extras


@query("SELECT r_name, n_name, count(DISTINCT c_mktsegment) AS segments, count(*) AS customers, CAST(grouping(r_name) + grouping(n_name) AS INTEGER) AS level FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def customer_rollup(spark, d):
    r = lambda t: fx.read(spark, d, t)
    rows = r("customer").join(r("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(r("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    out = rows.rollup("r_name", "n_name").agg(F.count_distinct("c_mktsegment").alias("segments"), F.count("*").alias("customers"), (F.grouping("r_name") + F.grouping("n_name")).cast("int").alias("level"))
    return out.select("r_name", "n_name", "segments", "customers", "level")


@query(f"""SELECT o_custkey, o_orderkey, CAST(lag(o_orderkey) OVER w AS BIGINT) AS before, CAST(lead(o_orderkey, 2) OVER w AS BIGINT) AS after, CAST(first_value(o_orderkey) OVER w AS BIGINT) AS first, CAST(ntile(3) OVER w AS INTEGER) AS third, {_fl('percent_rank() OVER w')} AS share, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS status,
  count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def order_windows(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    near = Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-1000, 0)
    rows = fx.read(spark, d, "orders")
    return rows.select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).cast("long").alias("before"), F.lead("o_orderkey", 2).over(w).cast("long").alias("after"), F.first("o_orderkey").over(w).cast("long").alias("first"), F.ntile(3).over(w).alias("third"), places(F.percent_rank().over(w), 4).alias("share"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderstatus")).alias("status"), F.count("*").over(near).alias("near"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, count(*) AS orders, CAST(min(date_diff('day', CAST(o_orderdate AS DATE), last_day(CAST(o_orderdate AS DATE)))) AS INTEGER) AS least_left, CAST(max(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH) AS DATE) AS month_on, max(json_extract_string('{\"a\": {\"b\": [' || (o_orderkey % 10) || ']}}', '$.a.b[0]')) AS most FROM orders GROUP BY 1, 2")
def order_dates(spark, d):
    day = F.col("o_orderdate").cast("date")
    inside = F.get_json_object(F.concat(F.lit('{"a": {"b": ['), (F.col("o_orderkey") % 10).cast("string"), F.lit("]}}")), "$.a.b[0]")
    rows = fx.read(spark, d, "orders")
    return rows.groupBy(F.year(day).alias("y"), F.quarter(day).alias("q")).agg(F.count("*").alias("orders"), F.min(F.date_diff(F.last_day(day), day)).alias("least_left"), F.max(F.add_months(day, 1)).alias("month_on"), F.max(inside).alias("most"))


# ---------------------------------------------------------------- more of what has a plain form in SQL

_LAST = f"""{LN}, m AS (SELECT task, count(*) AS events, sum(ti * ti) AS aa, sum(ti * (ti - 10000)) AS ab, sum((ti - 10000) * (ti - 10000)) AS bb, sum(ti * zi) AS ax, sum((ti - 10000) * zi) AS bx FROM z GROUP BY task),
e AS (SELECT task, events, CAST(aa AS DOUBLE) / 1e8 + 1e0 AS a, CAST(ab AS DOUBLE) / 1e8 AS b, CAST(bb AS DOUBLE) / 1e8 + 1e0 AS c, CAST(ax AS DOUBLE) / 1e12 + 0.5e0 AS x, CAST(bx AS DOUBLE) / 1e12 AS y FROM m)"""


@query(f"WITH {_LAST} SELECT task, events, {_fl('(x * c - b * y) / (a * c - b * b)')} AS rho, {_fl('(a * y - b * x) / (a * c - b * b)')} AS delta FROM e")
def reading_line_final(spark, d):
    out = arbitration.final_lines(fx.branches(spark, d))
    return out.select("task", "events", places(F.col("rho"), 4).alias("rho"), places(F.col("delta"), 4).alias("delta"))

