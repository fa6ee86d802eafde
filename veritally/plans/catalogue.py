"""The named queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as reading
from ..functions import tasks
from ..functions import text as T
from ..functions.hashing import feedback
from ..functions.maths import evidence, hard_label, inverse_logit, logit, places
from ..operators import addresses, arbitration, evaluation, order, quality, record, regimes, replay, reports, retrieval, streams, votes
from . import fixtures as fx
from .fixtures import AN, BR, EV, MI, OWN, PR, u

QUERIES = {}
ORACLE = {}
FLAGSHIP = "running_reliability"


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL that gives the same rows where SQL can."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _fl(x: str, n: int = 4) -> str:
    """Portable rounding in SQL."""
    return f"floor(({x}) * 1e{n} + 0.5e0) / 1e{n}"


_AUC = "SELECT {by} CASE WHEN sum(p) * sum(n) = 0 THEN NULL ELSE sum(CAST(p AS DOUBLE) * (CAST(less AS DOUBLE) + CAST(n AS DOUBLE) / 2)) / (CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) END AS auc FROM (SELECT {by} p, n, coalesce(sum(n) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM (SELECT {by} {score} AS s, sum({label}) AS p, sum(1 - {label}) AS n FROM {src} GROUP BY ALL)) {group}"


def _auc(src: str, score: str, label: str, by: str = "") -> str:
    return _AUC.format(by=f"{by}, " if by else "", part=f"PARTITION BY {by}" if by else "", group=f"GROUP BY {by}" if by else "", src=src, score=score, label=label)


_FAV = "fav AS (SELECT id, any_value(seq) AS seq, any_value(task) AS task, arg_max(peer, {s} * 1e6 - peer) AS favourite, CAST(count(*) AS INTEGER) AS n, CAST(sum(correct) AS INTEGER) AS rights, max({s}) - min({s}) AS spread FROM pr GROUP BY id), fv AS (SELECT fav.*, pr.correct AS favourite_right FROM fav JOIN pr ON pr.id = fav.id AND pr.peer = fav.favourite)"
FAV = _FAV.format(s="prob")
_ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


# ---------------------------------------------------------------- record and quality


@query(f"WITH {PR}, {FAV}, a AS ({_auc('pr', 'prob', 'correct', 'task')}) SELECT a.task, auc, CAST(count(*) AS BIGINT) AS mixed_events, CAST(sum(favourite_right) AS BIGINT) AS favourite_rights FROM a JOIN fv ON fv.task = a.task WHERE rights > 0 AND rights < n GROUP BY ALL")
def running_reliability(spark, d):
    rows = fx.estimates(spark, d)
    ranked = quality.auc(rows, "prob", "correct", ["task"])
    mixed = quality.mixed(quality.favourite(rows, "id", "peer", "prob", "correct", ["task"]))
    return ranked.join(mixed.groupBy("task").agg(F.count("*").alias("mixed_events"), F.sum(F.col("favourite_right").cast("long")).alias("favourite_rights")), "task")


@query(f"WITH {AN} SELECT id, peer, {_fl('CAST(coalesce(sum(correct) OVER w, 0) + 1 AS DOUBLE) / CAST(count(*) OVER w + 2 AS DOUBLE)')} AS prob FROM an WINDOW w AS (PARTITION BY peer, task ORDER BY seq {_ROWS})")
def running_by_task(spark, d):
    return quality.running_accuracy(fx.answers(spark, d), ["peer", "task"], "prob").select("id", "peer", "prob")


@query(f"WITH {AN} SELECT id, peer, CAST(sum(correct) OVER (PARTITION BY peer, task) AS DOUBLE) / CAST(count(*) OVER (PARTITION BY peer, task) AS DOUBLE) AS share FROM an")
def hindsight(spark, d):
    return quality.hindsight_accuracy(fx.answers(spark, d), ["peer", "task"], "share").select("id", "peer", "share")


@query(f"WITH {AN} SELECT peer, task, grouping(task)::INTEGER AS all_tasks, count(*) AS n, CAST(sum(correct) AS BIGINT) AS rights FROM an GROUP BY GROUPING SETS ((peer), (peer, task))")
def peer_accuracy_sets(spark, d):
    return quality.peer_accuracy(fx.answers(spark, d))


@query(f"WITH {PR} {_auc('pr', 'prob', 'correct')}")
def auc_overall(spark, d):
    return quality.auc(fx.estimates(spark, d), "prob", "correct")


@query(f"WITH {PR} {_auc('pr', 'prob', 'correct', 'task')}")
def auc_by_task(spark, d):
    return quality.auc(fx.estimates(spark, d), "prob", "correct", ["task"])


@query(f"WITH {PR}, {FAV} SELECT id, favourite, CAST(favourite_right AS INTEGER) AS favourite_right, rights FROM fv WHERE rights > 0 AND rights < n")
def favourite_on_mixed(spark, d):
    rows = quality.favourite(fx.estimates(spark, d), "id", "peer", "prob", "correct")
    return quality.mixed(rows).select("id", "favourite", "favourite_right", "rights")


@query(f"""WITH {PR}, {FAV} SELECT CASE WHEN rights = 0 OR rights = n THEN 'unanimous' WHEN spread <= 0.1e0 THEN 'split, flat'
  WHEN favourite_right = CASE WHEN rights * 2 > n THEN 1 ELSE 0 END THEN 'split, favourite with the majority' ELSE 'split, favourite against the majority' END AS part, count(*) AS events, CAST(sum(favourite_right) AS BIGINT) AS favourite_rights FROM fv GROUP BY 1""")
def event_partition(spark, d):
    rows = quality.favourite(fx.estimates(spark, d), "id", "peer", "prob", "correct")
    return rows.groupBy(quality.partition_label().alias("part")).agg(F.count("*").alias("events"), F.sum(F.col("favourite_right").cast("long")).alias("favourite_rights"))


def _segments(rule, windows):
    def run(spark, d):
        rows = fx.estimates(spark, d)
        n = fx.read(spark, d, "events").count()
        rows = rows.withColumn("segment", order.segment(F.col("seq"), n, windows, rule))
        ranked = quality.auc(rows, "prob", "correct", ["segment"])
        mixed = quality.mixed(quality.favourite(rows, "id", "peer", "prob", "correct", ["segment"]))
        return ranked.join(mixed.groupBy("segment").agg(F.count("*").alias("mixed_events"), F.sum(F.col("favourite_right").cast("long")).alias("favourite_rights")), "segment")

    return run


def _segments_sql(edge: str, windows: int) -> str:
    return f"""WITH {PR}, {FAV}, c AS (SELECT count(*) AS n FROM ev), e AS (SELECT {edge} AS edge FROM c, (SELECT unnest(range(1, {windows})) AS k)),
sg AS (SELECT seq AS q, CAST((SELECT count(*) FROM e WHERE edge <= ev.seq) AS INTEGER) AS segment FROM ev), ps AS (SELECT pr.*, segment FROM pr JOIN sg ON sg.q = pr.seq),
a AS ({_auc('ps', 'prob', 'correct', 'segment')}) SELECT a.segment, auc, count(*) AS mixed_events, CAST(sum(favourite_right) AS BIGINT) AS favourite_rights FROM a JOIN sg ON sg.segment = a.segment JOIN fv ON fv.seq = sg.q WHERE rights > 0 AND rights < fv.n GROUP BY ALL"""


QUERIES["stream_segments_floor"] = _segments("floor", 10)
ORACLE["stream_segments_floor"] = _segments_sql("n * k // 10", 10)
QUERIES["stream_segments_halfeven"] = _segments("even", 8)
ORACLE["stream_segments_halfeven"] = _segments_sql("CAST(round_even(CAST(k * n AS DOUBLE) / 8, 0) AS BIGINT)", 8)


@query(f"WITH {BR}, r AS (SELECT *, row_number() OVER (ORDER BY own_prob, alone_correct, id) - 1 AS rn, count(*) OVER () AS n FROM br) SELECT CAST(((rn + 1) * 12 - 1) // n AS INTEGER) AS bin, count(*) AS events, {_fl('sum(CAST(round(own_prob * 10000) AS BIGINT)) / 1e4 / count(*)')} AS mean_estimate, {_fl('CAST(sum(alone_correct) AS DOUBLE) / count(*)')} AS accuracy FROM r GROUP BY 1")
def calibration(spark, d):
    rows = fx.branches(spark, d)
    n = fx.read(spark, d, "events").count()
    rows = order.numbered(rows, ["own_prob", "alone_correct", "id"], "rn").withColumn("bin", order.equal_count_bin(F.col("rn"), F.lit(n), 12))
    total = F.sum(F.round(F.col("own_prob") * 10000).cast("long")).cast("double") / F.lit(1e4)
    return rows.groupBy("bin").agg(F.count("*").alias("events"), places(total / F.count("*").cast("double"), 4).alias("mean_estimate"), places(F.sum("alone_correct").cast("double") / F.count("*").cast("double"), 4).alias("accuracy"))


@query(f"WITH {EV}, c AS (SELECT count(*) AS n FROM ev) SELECT CAST(((seq + 1) * 24 - 1) // n AS INTEGER) AS bin, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq FROM ev, c GROUP BY 1")
def equal_count_bins(spark, d):
    rows = fx.events(spark, d)
    n = fx.read(spark, d, "events").count()
    return rows.groupBy(order.equal_count_bin(F.col("seq"), F.lit(n), 24).alias("bin")).agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"WITH {AN}, {OWN}, g AS (SELECT id, any_value(task) AS task, CAST(count(*) AS INTEGER) AS n, CAST(sum(correct) AS INTEGER) AS rights FROM an GROUP BY id) SELECT g.task, CAST(grouping(g.task) AS INTEGER) AS overall, count(*) AS events, CAST(sum(own_correct) AS DOUBLE) / count(*) AS rights_share, CAST(sum(CASE WHEN rights > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS oracle_share, CAST(sum(CASE WHEN rights * 2 > n THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS majority_share FROM g JOIN ow ON ow.id = g.id GROUP BY GROUPING SETS ((), (g.task))")
def eval_summary(spark, d):
    peers = fx.answers(spark, d).groupBy("id").agg(F.count("*").cast("int").alias("n"), F.sum("correct").cast("int").alias("rights"))
    return evaluation.summarise(fx.own(spark, d).withColumnRenamed("own_correct", "correct").join(peers, "id"))


@query(f"""WITH {EV}, {OWN}, c AS (SELECT count(*) AS n FROM ev), s AS (SELECT 'window ' || k AS part, n * k // 10 AS a, n * (k + 1) // 10 AS b FROM c, (SELECT unnest(range(0, 10)) AS k)
  UNION ALL SELECT 'first half', 0, n // 2 FROM c UNION ALL SELECT 'second half', n // 2, n FROM c UNION ALL SELECT 'first ' || k, 0, k FROM c, (SELECT unnest([250, 500, 1000, 2000, 4000, 8000, 16000]) AS k) WHERE k <= n)
SELECT part, count(*) AS events, CAST(sum(own_correct) AS BIGINT) AS rights FROM s JOIN ow ON seq >= a AND seq < b GROUP BY part""")
def stream_curve(spark, d):
    return evaluation.curve(fx.own(spark, d), fx.read(spark, d, "events").count(), 10, hit="own_correct")


# ---------------------------------------------------------------- votes

_ANS = u("'ans|' || peer || '|' || id")


def _choices(spark, d):
    from ..functions.hashing import stable_fraction

    said = F.when(stable_fraction("ans", F.col("peer"), F.col("id")) < 0.5, "Final answer: yes").when(stable_fraction("ans", F.col("peer"), F.col("id")) < 0.9, "I think the answer is no").otherwise("hard to say")
    return fx.answers(spark, d).withColumn("text", said).withColumn("answer", T.yes_no_answer(F.col("text")))


CH = f"{AN}, ch AS (SELECT *, CASE WHEN {_ANS} < 0.5e0 THEN 'key yes' WHEN {_ANS} < 0.9e0 THEN 'key no' ELSE 'alone ' || peer END AS g FROM an)"
VO = f"{CH}, gr AS (SELECT id, task, g, count(*) AS c, avg(CAST(correct AS DOUBLE)) AS share FROM ch GROUP BY ALL), tp AS (SELECT *, max(c) OVER (PARTITION BY id) AS m FROM gr), vo AS (SELECT id, task, avg(share) AS correct, CAST(m AS INTEGER) AS votes, CAST(count(*) AS INTEGER) AS tied FROM tp WHERE c = m GROUP BY id, task, m)"


@query(f"WITH {VO} SELECT id, {_fl('correct')} AS correct, votes, tied FROM vo")
def plurality_vote(spark, d):
    rows = _choices(spark, d).withColumn("g", votes.group_key(F.col("answer"), F.col("peer")))
    return votes.plurality(rows, "id", "g", "correct").select("id", places(F.col("correct"), 4).alias("correct"), "votes", "tied")


@query(f"WITH {VO} SELECT task, CAST(grouping(task) AS INTEGER) AS overall, count(*) AS events, {_fl('avg(' + _fl('correct') + ')')} AS expected_accuracy, {_fl('avg(CASE WHEN tied > 1 THEN 1e0 ELSE 0e0 END)')} AS tie_share FROM vo GROUP BY GROUPING SETS ((), (task))")
def vote_summary(spark, d):
    rows = _choices(spark, d).withColumn("g", votes.group_key(F.col("answer"), F.col("peer")))
    out = votes.vote_summary(votes.plurality(rows, "id", "g", "correct", ["task"]).withColumn("correct", places(F.col("correct"), 4)))
    return out.withColumns({c: places(F.col(c), 4) for c in ("expected_accuracy", "tie_share")})


# ---------------------------------------------------------------- controls, tilt, evidence


@query(f"WITH {PR}, rk AS (SELECT id, peer, prob, row_number() OVER (PARTITION BY id ORDER BY prob, peer) AS r, count(*) OVER (PARTITION BY id) AS n FROM pr) SELECT a.id, a.peer, a.prob, b.prob AS swapped FROM rk a JOIN rk b ON a.id = b.id AND b.r = a.n + 1 - a.r")
def swap_control(spark, d):
    return evaluation.swapped(fx.estimates(spark, d), "id", "peer", "prob").select("id", "peer", "prob", "swapped")


@query(f"WITH {PR}, m AS (SELECT id, peer, prob, max(prob) OVER (PARTITION BY id) AS top, min(prob) OVER (PARTITION BY id) AS low FROM pr) SELECT id, peer, CASE WHEN top - low <= 0.1e0 THEN 0e0 ELSE {_fl('3e0 * ln(greatest(prob, 1e-3) / greatest(top, 1e-3))')} END AS tilt FROM m")
def tilt_values(spark, d):
    out = evaluation.tilted(fx.estimates(spark, d), "id", "prob", 3.0)
    return out.select("id", "peer", F.when(F.col("tilt") == 0, 0.0).otherwise(places(F.col("tilt"), 4)).alias("tilt"))


@query(f"""WITH {PR}, l AS (SELECT id, peer, seq, ln(least(greatest(prob, 1e-6), 1 - 1e-6)) - ln(1 - least(greatest(prob, 1e-6), 1 - 1e-6)) AS o FROM pr),
g AS (SELECT *, sum(o) OVER (PARTITION BY id) AS total, count(*) OVER (PARTITION BY id) AS n FROM l), b AS (SELECT a.id, a.peer, max(b.o) AS others FROM l a JOIN l b ON a.id = b.id AND a.peer <> b.peer GROUP BY ALL)
SELECT g.id, g.peer, {_fl('o', 3)} AS own_logit, {_fl('others', 3)} AS others_max, {_fl('(total - o) / (n - 1)', 3)} AS others_mean, {_fl('least(1e0, ln(1 + CAST(seq AS DOUBLE)) / ln(101e0))', 3)} AS support FROM g JOIN b ON b.id = g.id AND b.peer = g.peer""")
def leave_one_out(spark, d):
    out = evaluation.leave_one_out(fx.estimates(spark, d), "id", "prob", "seq")
    return out.select("id", "peer", *[places(F.col(c), 3).alias(c) for c in ("own_logit", "others_max", "others_mean", "support")])


@query(f"WITH {EV} SELECT id, {u(chr(39) + '7:' + chr(39) + ' || id')} < 0.25e0 AS written FROM ev")
def feedback_mask(spark, d):
    return fx.events(spark, d).select("id", feedback(F.col("id"), 0.25, 7).alias("written"))


# ---------------------------------------------------------------- regimes and derived streams


def _regime(regime):
    def run(spark, d):
        rows = fx.misleading(spark, d)
        n = fx.read(spark, d, "events").count()
        rows = rows.withColumn("position", order.position(F.col("seq"), n))
        return regimes.select_answers(rows, regime, n).filter("selected").select("id", "peer")

    return run


def _key(name: str) -> str:
    return u(f"'0|{name}|' || peer || '|' || id")


EXACT = f"SELECT id, peer FROM (SELECT *, row_number() OVER (PARTITION BY peer ORDER BY {_key('sweep')}, id) AS r FROM mi WHERE usable) WHERE r <= (SELECT CAST(round_even(0.3e0 * count(*), 0) AS BIGINT) FROM ev)"
for _name, _r, _sql in (
    ("regime_fraction", regimes.Regime("part", "fraction", 0.4, peers=(0, 2, 4)), f"SELECT id, peer FROM mi WHERE peer IN (0, 2, 4) AND {_key('part')} < 0.4e0"),
    ("regime_exact", regimes.shorthand("p030"), EXACT),
    ("regime_count", regimes.shorthand("k2"), f"SELECT id, peer FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {u(chr(39) + '0|count|' + chr(39) + ' || id || ' + chr(39) + '|' + chr(39) + ' || peer')}, peer) AS r FROM mi WHERE usable) WHERE r <= 2"),
    ("regime_targeted", regimes.Regime("aim", "targeted", 0.5), f"SELECT id, peer FROM mi WHERE correct = 1 AND {_key('aim')} < 0.5e0"),
    ("regime_flip", regimes.Regime("late", "flip", at=0.6, peers=(1, 3)), "SELECT id, peer FROM mi, (SELECT count(*) AS n FROM ev) WHERE peer IN (1, 3) AND CAST(seq AS DOUBLE) / CAST(n AS DOUBLE) >= 0.6e0"),
):
    QUERIES[_name] = _regime(_r)
    ORACLE[_name] = f"WITH {MI} {_sql}"

RE = f"{MI}, sel AS ({EXACT}), re AS (SELECT mi.*, sel.id IS NOT NULL AS selected, sel.id IS NOT NULL AND usable AS misled, CAST(CASE WHEN sel.id IS NOT NULL AND usable THEN 0 ELSE correct END AS INTEGER) AS label FROM mi LEFT JOIN sel ON sel.id = mi.id AND sel.peer = mi.peer)"


def _replaced(spark, d):
    n = fx.read(spark, d, "events").count()
    return regimes.replace(regimes.select_answers(fx.misleading(spark, d), regimes.shorthand("p030"), n))


@query(f"WITH {RE} SELECT id, peer, misled, label FROM re")
def replace_stream(spark, d):
    return _replaced(spark, d).select("id", "peer", "misled", "label")


@query(f"WITH {RE} SELECT peer, count(*) AS events, count(*) FILTER (usable) AS usable_answers, count(*) FILTER (selected) AS selected_answers, count(*) FILTER (misled) AS misled_answers, count(*) FILTER (misled AND forced) AS forced_answers, count(*) FILTER (selected AND NOT misled) AS unavailable, CAST(sum(correct) AS BIGINT) AS rights_before, CAST(sum(label) AS BIGINT) AS rights_after FROM re GROUP BY peer")
def replace_manifest(spark, d):
    return regimes.replacement_manifest(_replaced(spark, d))


@query(f"WITH {RE} SELECT misled_peers, count(*) AS events FROM (SELECT id, CAST(sum(CASE WHEN misled THEN 1 ELSE 0 END) AS INTEGER) AS misled_peers FROM re GROUP BY id) GROUP BY 1")
def misled_histogram(spark, d):
    return regimes.misled_histogram(_replaced(spark, d))


@query(f"""WITH {RE}, pp AS (SELECT *, floor(CAST(coalesce(sum(label) OVER w, 0) + 1 AS DOUBLE) / CAST(count(*) OVER w + 2 AS DOUBLE) * 1e4 + 0.5e0) / 1e4 AS prob FROM re WINDOW w AS (PARTITION BY peer ORDER BY seq {_ROWS})),
fq AS (SELECT id, arg_max(misled, prob * 1e6 - peer) AS worst, bool_or(misled) AS touched FROM pp GROUP BY id)
SELECT (SELECT {_fl('sum(CAST(round(prob * 10000) AS BIGINT)) / 1e4 / count(*)')} FROM pp WHERE NOT misled) AS mean_honest, (SELECT {_fl('sum(CAST(round(prob * 10000) AS BIGINT)) / 1e4 / count(*)')} FROM pp WHERE misled) AS mean_misled,
  (SELECT {_fl('auc')} FROM (SELECT 1 - auc AS auc FROM ({_auc('pp', 'prob', 'CASE WHEN misled THEN 1 ELSE 0 END')}))) AS separation, (SELECT {_fl('CAST(count(*) FILTER (worst) AS DOUBLE) / count(*)')} FROM fq WHERE touched) AS favourite_misled""")
def misleading_probe(spark, d):
    rows = quality.running_accuracy(_replaced(spark, d), ["peer"], "prob", label="label").withColumn("bad", F.col("misled").cast("int"))
    mean = lambda c: places(F.sum(F.when(c, F.round(F.col("prob") * 10000).cast("long"))).cast("double") / F.lit(1e4) / F.sum(F.when(c, 1)).cast("double"), 4)
    means = rows.agg(mean(F.col("bad") == 0).alias("mean_honest"), mean(F.col("bad") == 1).alias("mean_misled"))
    apart = quality.auc(rows, "prob", "bad").select(places(F.lit(1.0) - F.col("auc"), 4).alias("separation"))
    best = quality.favourite(rows, "id", "peer", "prob", "bad").filter("rights > 0").agg(places(F.sum("favourite_right").cast("double") / F.count("*").cast("double"), 4).alias("favourite_misled"))
    one = F.lit(1).alias("k")
    return means.select("*", one).join(apart.select("*", one), "k").join(best.select("*", one), "k").drop("k")


ADD = f"{AN}, a2 AS (SELECT id, 'peer_' || peer AS peer, 'Final answer: ' || peer AS response, correct FROM an WHERE {u(chr(39) + 'has|' + chr(39) + ' || peer || ' + chr(39) + '|' + chr(39) + ' || id')} < 0.9e0)"


def _added(spark, d):
    from ..functions.hashing import stable_fraction

    rows = fx.answers(spark, d).filter(stable_fraction("has", F.col("peer"), F.col("id")) < 0.9)
    return rows.select("id", F.concat(F.lit("peer_"), F.col("peer").cast("string")).alias("peer"), F.concat(F.lit("Final answer: "), F.col("peer").cast("string")).alias("response"), "correct")


@query(f"WITH {ADD} SELECT id, max(response) FILTER (peer = 'peer_1') AS first, max(response) FILTER (peer = 'peer_4') AS second, CAST(sum(correct) AS INTEGER) AS rights FROM a2 WHERE peer IN ('peer_1', 'peer_4') GROUP BY id HAVING count(*) = 2")
def add_answers(spark, d):
    out = streams.add_answers(fx.events(spark, d), _added(spark, d), ["peer_1", "peer_4"])
    return out.select("id", F.col("responses")["peer_1"].alias("first"), F.col("responses")["peer_4"].alias("second"), (F.col("labels")["peer_1"] + F.col("labels")["peer_4"]).cast("int").alias("rights"))


@query(f"WITH {ADD} SELECT p AS peer, (SELECT count(*) FROM ev) - (SELECT count(DISTINCT id) FROM a2 WHERE a2.peer = p) AS dropped FROM (SELECT unnest(['peer_1', 'peer_4']) AS p)")
def dropped_answers(spark, d):
    return streams.missing_answers(fx.events(spark, d), _added(spark, d), ["peer_1", "peer_4"])


@query(f"WITH {EV}, s AS (SELECT source AS k, id, task, seq FROM ev) SELECT k, arg_max(id, seq) AS id, arg_max(task, seq) AS task, max(seq) AS seq FROM s GROUP BY k")
def last_wins(spark, d):
    return streams.last_wins(fx.events(spark, d).select(F.col("source").alias("k"), "id", "task", "seq"), "k", ["seq"])


@query(f"WITH {EV} SELECT id, seq FROM ev WHERE NOT (task = 'click' AND seq % 3 = 0)")
def pending_events(spark, d):
    rows = fx.events(spark, d)
    return streams.pending(rows, rows.filter("task = 'click' AND seq % 3 = 0")).select("id", "seq")


@query(f"WITH {EV} SELECT id, seq FROM ev")
def shard_merge(spark, d):
    rows = fx.events(spark, d)
    return streams.merge_shards([order.systematic(rows, "seq", shard=k, shards=4).select("id", "seq") for k in range(4)])


@query(f"WITH {EV} SELECT id, seq FROM ev WHERE seq % 5 = 0 AND seq // 5 < 300 AND (seq // 5) % 4 = 1")
def systematic_sample(spark, d):
    return order.systematic(fx.events(spark, d), "seq", 5, 300, 1, 4).select("id", "seq")


@query(f"WITH {AN}, b AS (SELECT CAST('0x' || substr(sha256(id || '|' || peer || '|' || correct), 1, 8) AS BIGINT) AS b FROM an) SELECT count(*) AS events, CAST(sum(b) % 4294967296 AS BIGINT) AS digest_sum, CAST(bit_xor(b) AS BIGINT) AS digest_xor FROM b")
def content_digest(spark, d):
    return streams.content_digest(fx.answers(spark, d), ["id", "peer", "correct"])


# ---------------------------------------------------------------- arbitration

LN = f"""{BR}, w AS (SELECT *, CAST(round(trust * 10000) AS HUGEINT) AS ti, CAST(round(own_prob * 10000) AS HUGEINT) AS ki FROM br),
z AS (SELECT *, read_correct * CAST(100000000 AS HUGEINT) - (10000 - ti) * ki AS zi FROM w),
s AS (SELECT *, CAST(coalesce(sum(ti * ti) OVER o, 0) AS DOUBLE) / 1e8 + 1e0 AS a, CAST(coalesce(sum(ti * (ti - 10000)) OVER o, 0) AS DOUBLE) / 1e8 AS b, CAST(coalesce(sum((ti - 10000) * (ti - 10000)) OVER o, 0) AS DOUBLE) / 1e8 + 1e0 AS c,
  CAST(coalesce(sum(ti * zi) OVER o, 0) AS DOUBLE) / 1e12 + 0.5e0 AS x, CAST(coalesce(sum((ti - 10000) * zi) OVER o, 0) AS DOUBLE) / 1e12 AS y FROM z WINDOW o AS (PARTITION BY task ORDER BY seq {_ROWS})),
rd AS (SELECT *, (x * c - b * y) / (a * c - b * b) AS rho, (a * y - b * x) / (a * c - b * b) AS delta FROM s),
ln AS (SELECT *, trust * rho + (1e0 - trust) * (own_prob - delta) AS value FROM rd), cb AS (SELECT *, value >= own_prob AS reads, CASE WHEN value >= own_prob THEN read_correct ELSE alone_correct END AS correct FROM ln)"""


def _lines(spark, d):
    return arbitration.combined(arbitration.reading_line(fx.branches(spark, d)))


@query(f"WITH {LN} SELECT id, {_fl('rho')} AS rho, {_fl('delta')} AS delta, {_fl('value')} AS value, reads FROM cb")
def reading_line(spark, d):
    return _lines(spark, d).select("id", *[places(F.col(c), 4).alias(c) for c in ("rho", "delta", "value")], "reads")


@query(f"""WITH {LN} SELECT count(*) AS events, {', '.join(_fl(f'CAST(sum({c}) AS DOUBLE) / count(*)') + f' AS {n}' for c, n in (('reads::INTEGER', 'share_read'), ('read_correct', 'read_accuracy'), ('alone_correct', 'alone_accuracy'), ('greatest(read_correct, alone_correct)', 'either_right'), ('correct', 'accuracy')))},
  count(*) FILTER (read_correct = 1 AND alone_correct = 0) AS read_cases, count(*) FILTER (read_correct = 1 AND alone_correct = 0 AND reads) AS read_picked, count(*) FILTER (alone_correct = 1 AND read_correct = 0) AS alone_cases, count(*) FILTER (alone_correct = 1 AND read_correct = 0 AND NOT reads) AS alone_picked FROM cb""")
def combination_metrics(spark, d):
    out = arbitration.combination_metrics(_lines(spark, d))
    return out.withColumns({c: places(F.col(c), 4) for c in ("share_read", "read_accuracy", "alone_accuracy", "either_right", "accuracy")})


@query(f"WITH {LN} SELECT least(4, CAST(floor(trust * 5) AS INTEGER)) AS band, count(*) AS events, CAST(sum(reads::INTEGER) AS BIGINT) AS reads_total, CAST(sum(read_correct) AS BIGINT) AS read_rights, CAST(sum(alone_correct) AS BIGINT) AS alone_rights, CAST(sum(correct) AS BIGINT) AS rights FROM cb GROUP BY 1")
def trust_bands(spark, d):
    return arbitration.trust_bands(_lines(spark, d))


@query(f"WITH {LN}, r AS (SELECT {_fl('value - own_prob')} AS gain, read_correct - alone_correct AS seen, row_number() OVER (ORDER BY {_fl('value - own_prob')}, read_correct - alone_correct, id) - 1 AS rn, count(*) OVER () AS n FROM cb) SELECT CAST(((rn + 1) * 8 - 1) // n AS INTEGER) AS bin, count(*) AS events, CAST(sum(seen) AS BIGINT) AS observed, min(gain) AS least_gain, max(gain) AS most_gain FROM r GROUP BY 1")
def gain_bins(spark, d):
    rows = _lines(spark, d).select("id", places(F.col("value") - F.col("own_prob"), 4).alias("gain"), (F.col("read_correct") - F.col("alone_correct")).alias("seen"))
    n = fx.read(spark, d, "events").count()
    rows = order.numbered(rows, ["gain", "seen", "id"], "rn")
    return rows.groupBy(order.equal_count_bin(F.col("rn"), F.lit(n), 8).alias("bin")).agg(F.count("*").alias("events"), F.sum(F.col("seen").cast("long")).alias("observed"), F.min("gain").alias("least_gain"), F.max("gain").alias("most_gain"))


# ---------------------------------------------------------------- checks, tasks


@query("""WITH r AS (SELECT doc_id % 4 AS source, quality AS y, toxic AS r FROM labels) SELECT coalesce(CAST(source AS VARCHAR), 'all') AS source, CAST(grouping(source) AS INTEGER) AS overall, count(*) AS reports, round_even(100e0 * sum(y) / greatest(1, count(*)), 2) AS right_share, round_even(100e0 * sum(r) / greatest(1, count(*)), 2) AS rejected_share,
  round_even(100e0 * sum(CASE WHEN r = 1 AND y = 0 THEN 1 ELSE 0 END) / greatest(1, sum(1 - y)), 2) AS wrong_caught, round_even(100e0 * sum(CASE WHEN r = 1 AND y = 1 THEN 1 ELSE 0 END) / greatest(1, sum(y)), 2) AS right_rejected FROM r GROUP BY GROUPING SETS ((), (source))""")
def confusion_rates(spark, d):
    rows = fx.read(spark, d, "labels").select((F.col("doc_id") % 4).alias("source"), "quality", "toxic")
    return replay.check_quality(rows, "source", "quality", "toxic").withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("all")))


@query(f"WITH {EV}, {OWN} SELECT count(*) AS tasks, CAST(sum(ok) AS BIGINT) AS solved FROM (SELECT seq // 3 AS k, min(own_correct) AS ok FROM ow GROUP BY 1)")
def task_success(spark, d):
    return replay.task_success(fx.own(spark, d).withColumn("k", F.floor(F.col("seq") / 3)), "k", "own_correct")


# ---------------------------------------------------------------- text

_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def _norm(x: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(translate(lower({x}), '{_PUNCT}', ''), '[\\s\\p{{Z}}]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


@query(f"SELECT doc_id, md5({_norm('text')}) AS normal FROM documents")
def qa_normalise(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", F.md5(T.qa_normalise(F.col("text"))).alias("normal"))


QA = f"b AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) AS k FROM benchmark), q AS (SELECT x.item_id, y.item_id AS other, string_split({_norm('x.text')}, ' ') AS p, string_split({_norm('y.text')}, ' ') AS g FROM b x JOIN b y ON y.k BETWEEN x.k AND x.k + 3)"


def _qa_pairs(spark, d):
    b = order.numbered(fx.read(spark, d, "benchmark").select("item_id", "text"), ["item_id"], "k")
    near = b.withColumn("k", F.explode(F.sequence(F.col("k"), F.col("k") + 3)))
    return near.join(b.select("k", F.col("item_id").alias("other"), F.col("text").alias("gold")), "k")


@query(f"WITH {QA}, c AS (SELECT item_id, other, CAST(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda v: v = w)), len(list_filter(g, lambda v: v = w))))) AS DOUBLE) AS o, CAST(len(p) AS DOUBLE) AS n, CAST(len(g) AS DOUBLE) AS m FROM q) SELECT item_id, other, CASE WHEN o = 0 THEN 0e0 ELSE {_fl('2e0 * (o / n) * (o / m) / (o / n + o / m)')} END AS f1 FROM c")
def qa_f1(spark, d):
    return _qa_pairs(spark, d).select("item_id", "other", places(T.token_f1(F.col("text"), F.col("gold")), 4).alias("f1"))


@query(f"WITH {QA} SELECT item_id, other, p = g AS matches FROM q")
def exact_match(spark, d):
    return _qa_pairs(spark, d).select("item_id", "other", T.exact_match(F.col("text"), F.array("gold")).alias("matches"))


SAID = "(text || CASE doc_id % 5 WHEN 0 THEN chr(10) || 'Final answer: ' || lang || '.' WHEN 1 THEN chr(10) || 'the answer is  yes' WHEN 2 THEN chr(10) || 'No, TRUE' WHEN 3 THEN chr(10) || '  (B) ' ELSE '' END)"
_BLANK = "' ' || chr(10) || chr(9) || chr(13)"


def _said(spark, d):
    """Whole texts with a closing line in one of four forms, or none."""
    k = F.col("doc_id") % 5
    end = F.when(k == 0, F.concat(F.lit("\nFinal answer: "), "lang", F.lit("."))).when(k == 1, "\nthe answer is  yes").when(k == 2, "\nNo, TRUE").when(k == 3, "\n  (B) ").otherwise("")
    return fx.read(spark, d, "documents").select("doc_id", "lang", F.concat("text", end).alias("said"))


@query(f"WITH l AS (SELECT doc_id, lang, {SAID} AS said FROM documents), r AS (SELECT *, list_filter(list_transform(string_split(said, chr(10)), lambda x: trim(trim(x, {_BLANK}), '.')), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS ls FROM l) SELECT doc_id, md5(CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN 'yes' ELSE coalesce(ls[-1], trim(trim(said, {_BLANK}), '.')) END) AS answer FROM r")
def answer_extract(spark, d):
    return _said(spark, d).select("doc_id", F.md5(T.qa_answer(F.col("said"))).alias("answer"))


@query(f"WITH l AS (SELECT doc_id, lang, list_filter(list_transform(string_split({SAID}, chr(10)), lambda x: trim(x, {_BLANK})), lambda x: x <> '') AS ls FROM documents), r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN 'yes' ELSE coalesce(ls[-1], '') END AS a FROM l) SELECT doc_id, md5({_norm('a')}) AS answer FROM r")
def short_extract(spark, d):
    return _said(spark, d).select("doc_id", F.md5(T.short_normalise(T.short_answer(F.col("said")))).alias("answer"))


@query(f"WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower({SAID}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: x IN ('yes', 'no', 'true', 'false')) AS ws FROM documents) SELECT doc_id, CASE WHEN len(ws) = 0 THEN '' WHEN ws[-1] IN ('yes', 'true') THEN 'yes' ELSE 'no' END AS answer FROM w")
def bool_extract(spark, d):
    return _said(spark, d).select("doc_id", T.yes_no_answer(F.col("said")).alias("answer"))


@query(f"SELECT doc_id, md5(lower(trim(regexp_replace(trim({SAID}, ' ' || chr(10) || chr(9) || chr(13)), '^[()\\[\\]{{}}]+|[()\\[\\]{{}}]+$', '', 'g'), ' ' || chr(10) || chr(9) || chr(13)))) AS label FROM documents")
def option_labels(spark, d):
    return _said(spark, d).select("doc_id", F.md5(T.option_label(F.col("said"))).alias("label"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'REJECT' ELSE 'ACCEPT' END AS verdict, CASE WHEN turn % 3 = 0 THEN 'too short' ELSE substr(trim(string_split(coalesce(text, ''), chr(10))[1]), 1, 500) END AS critique FROM conversations")
def verdicts(spark, d):
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\nVerdict: ** reject\nCritique:  too short\nmore"))).otherwise(F.col("text"))
    rows = fx.read(spark, d, "conversations").select("conv_id", "turn", t.alias("t"))
    return rows.select("conv_id", "turn", T.verdict(F.col("t")).alias("verdict"), T.critique(F.col("t")).alias("critique"))


@query("WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+'), lambda x: true) AS ws FROM documents), t AS (SELECT doc_id, CAST(len(ws) AS INTEGER) AS n, list_filter(ws, lambda x: length(x) > 2) AS l FROM w), m AS (SELECT doc_id, n, coalesce(list_max(map_values(list_histogram(l))), 0) AS top FROM (SELECT doc_id, n, l FROM t)) SELECT doc_id, n AS words, n >= 30 AND top > 20 AND top > 0.3e0 * n AS much FROM m")
def loop_counts(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", F.size(T.word_list(F.col("text"))).alias("words"), T.much_of_one_word(F.col("text")).alias("much"))


_WORDCHAR = "[\\p{L}\\p{N}\\p{M}_]"


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), m AS (SELECT doc_id, regexp_extract_all(lower(x), '{_WORDCHAR}+') AS ws FROM t), n AS (SELECT doc_id, len(ws) AS n, coalesce(list_max(map_values(list_histogram(list_filter(ws, lambda w: length(w) > 2)))), 0) AS top FROM m),
s AS (SELECT doc_id, string_split_regex(lower(x), '[\\s\\p{{Z}}]+') AS ws FROM t), r AS (SELECT doc_id, ws[i] AS a, ws[i + 1] AS v, ws[i + 9] AS z FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 8)) AS i FROM s WHERE len(ws) >= 10) WHERE len(list_distinct(ws[i + 1:i + 8])) = 1 AND regexp_full_match(ws[i + 1], '[a-z]{_WORDCHAR}+')),
q AS (SELECT DISTINCT doc_id FROM r WHERE regexp_matches(a, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])' || v || '$') AND regexp_matches(z, '^' || v || '($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])'))
SELECT n.doc_id, (n >= 30 AND top > 20 AND top > 0.3e0 * n) OR q.doc_id IS NOT NULL AS looped FROM n LEFT JOIN q ON q.doc_id = n.doc_id""")
def loop_detect(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", T.looped(F.col("text")).alias("looped"))


def _content(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.CONTENT_STOPWORDS)
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z]{{4,}}'), lambda w: w NOT IN ({stop})))"


@query(f"""WITH q AS (SELECT d.doc_id, d.text, coalesce(b.text, '') AS question FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 40), x AS (SELECT *, regexp_replace(regexp_replace(coalesce(text, ''), '(?i){T.ANSWER_PHRASE}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM q),
y AS (SELECT *, {_content('body')} AS mine, {_content('question')} AS theirs, length(regexp_replace(body, '[^\\p{{L}}]', '', 'g')) AS letters FROM x)
SELECT doc_id, length(body) >= 20 AND (regexp_matches(body, '(?m){T.CODE_MARK}') OR (length(body) > 60 AND letters < 0.25e0 * length(body)) OR (len(mine) >= 8 AND len(theirs) >= 3 AND NOT list_has_any(mine, theirs))) AS off_topic FROM y""")
def off_topic(spark, d):
    """Documents beside the item of their number, or no question where there is none."""
    rows = fx.read(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id"))
    items = fx.read(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    return rows.join(items, "item_id", "left").select("doc_id", T.off_topic(F.col("text"), F.coalesce("question", F.lit(""))).alias("off_topic"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 3000 THEN rtrim(substr(text, 1, 3000), ' ' || chr(10) || chr(9) || chr(13)) || chr(10) || '[... reasoning cut off, no final answer]' ELSE text END) AS block FROM documents")
def peer_blocks(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", F.md5(T.peer_block(F.col("text"))).alias("block"))


@query(f"""WITH c AS (SELECT conv_id, list(CASE WHEN length(trim(text, ' ' || chr(10) || chr(9))) <= 200 THEN trim(text, ' ' || chr(10) || chr(9)) ELSE rtrim(substr(trim(text, ' ' || chr(10) || chr(9)), 1, 200), ' ' || chr(10) || chr(9)) || ' ...' END ORDER BY turn) AS b FROM conversations WHERE text IS NOT NULL AND role = 'assistant' GROUP BY conv_id)
SELECT conv_id, md5('Question:' || chr(10) || conv_id || chr(10) || chr(10) || array_to_string(list_transform(b, lambda x, i: 'Peer ' || i || ':' || chr(10) || x), chr(10) || chr(10)) || chr(10) || chr(10) || 'Answer now.') AS user_message FROM c""")
def prompt_assembly(spark, d):
    rows = fx.read(spark, d, "conversations").filter("text IS NOT NULL AND role = 'assistant'")
    blocks = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("b"))
    messages = T.prompt("You answer.", F.col("conv_id").cast("string"), F.col("b"), "Answer now.", limit=200)
    return blocks.select("conv_id", F.md5(F.get(messages, 1)["content"]).alias("user_message"))


@query("SELECT conv_id, 2 + 2 * count(*) AS messages, md5(string_agg(text, '|' ORDER BY turn)) AS said FROM conversations WHERE text IS NOT NULL AND role = 'assistant' GROUP BY conv_id")
def debate_turns(spark, d):
    rows = fx.read(spark, d, "conversations").filter("text IS NOT NULL AND role = 'assistant'")
    history = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("h"))
    first = T.prompt("You answer.", F.col("conv_id").cast("string"), F.array().cast("array<string>"), "Answer now.")
    turns = history.select("conv_id", T.debate(first, F.col("h"), "Think again.").alias("m"))
    said = F.array_join(F.transform(F.filter("m", lambda x: x["role"] == "assistant"), lambda x: x["content"]), "|")
    return turns.select("conv_id", F.size("m").cast("long").alias("messages"), F.md5(said).alias("said"))


@query("SELECT doc_id, hash_free AS filled FROM (SELECT doc_id, 'Where was ' || lang || ' of ' || source || '0 born?' AS hash_free FROM documents)")
def reference_filling(spark, d):
    rows = fx.read(spark, d, "documents")
    return rows.select("doc_id", T.filled_question(F.lit("Where was #1 of #20 born?"), F.array(F.col("lang"), *[F.lit("x")] * 18, F.concat("source", F.lit("0")))).alias("filled"))


@query()
def final_answers(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", reading.final_answer_udf("text").alias("answer"))


# ---------------------------------------------------------------- retrieval

_STOP = ", ".join(f"'{w}'" for w in retrieval.STOPWORDS)
BM = f"""tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS term FROM documents), dt AS (SELECT doc_id, term, count(*) AS n FROM tk WHERE term NOT IN ({_STOP}) GROUP BY ALL),
qt AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS term FROM benchmark) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
sz AS (SELECT doc_id, sum(n) AS size FROM dt GROUP BY 1), nd AS (SELECT CAST(count(*) AS DOUBLE) AS docs FROM documents), av AS (SELECT CAST(sum(size) AS DOUBLE) / any_value(docs) AS a FROM sz, nd), fr AS (SELECT term, count(*) AS df FROM dt GROUP BY 1),
sc AS (SELECT item_id, doc_id, floor(CAST(sum(CAST(round(CAST(n AS DOUBLE) * 2.5e0 / (CAST(n AS DOUBLE) + 1.5e0 * (0.25e0 + 0.75e0 * CAST(size AS DOUBLE) / a)) * ln(1e0 + (docs - df + 0.5e0) / (df + 0.5e0)) * times * 1e6) AS HUGEINT)) AS DOUBLE) / 1e6 * 1e4 + 0.5e0) / 1e4 AS score
  FROM qt JOIN dt USING (term) JOIN fr USING (term) JOIN sz USING (doc_id), nd, av GROUP BY ALL), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc)"""


@query(f"WITH {BM} SELECT item_id, doc_id, score, rank FROM rk WHERE rank <= 3")
def bm25_topk(spark, d):
    return retrieval.top(retrieval.bm25(fx.read(spark, d, "documents"), fx.read(spark, d, "benchmark")), "item_id", "doc_id", 3)


@query(f"WITH {BM}, s AS (SELECT item_id, doc_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)) SELECT count(DISTINCT s.item_id) AS queries, count(DISTINCT s.item_id) FILTER (rk.doc_id IS NOT NULL) AS found FROM s LEFT JOIN rk ON rk.item_id = s.item_id AND rk.doc_id = s.doc_id AND rank <= 3")
def retrieval_recall(spark, d):
    docs, items = fx.read(spark, d, "documents"), fx.read(spark, d, "benchmark")
    ranked = retrieval.top(retrieval.bm25(docs, items), "item_id", "doc_id", 3)
    support = retrieval.holding(docs, items)
    return retrieval.recall(ranked, support, "item_id", "doc_id")


# ---------------------------------------------------------------- the record

RS = f"""v AS (SELECT vec_id, vec_id % 4 AS stream, CAST(floor(CAST(embedding[1] AS DOUBLE) * 1000) AS HUGEINT) AS a, CAST(floor(CAST(embedding[2] AS DOUBLE) * 1000) AS HUGEINT) AS b, CASE WHEN label % 3 = 0 THEN 1 ELSE -1 END AS s FROM embeddings),
p AS (SELECT *, CAST(coalesce(sum(a * a) OVER w, 0) AS DOUBLE) / 1e6 + 1e0 AS p, CAST(coalesce(sum(a * b) OVER w, 0) AS DOUBLE) / 1e6 AS q, CAST(coalesce(sum(b * b) OVER w, 0) AS DOUBLE) / 1e6 + 1e0 AS r, CAST(coalesce(sum(a * s) OVER w, 0) AS DOUBLE) / 1e3 AS x, CAST(coalesce(sum(b * s) OVER w, 0) AS DOUBLE) / 1e3 AS y,
  CAST(a AS DOUBLE) / 1e3 AS u, CAST(b AS DOUBLE) / 1e3 AS v FROM v WINDOW w AS (PARTITION BY stream ORDER BY vec_id {_ROWS})), m AS (SELECT vec_id, ((r * u - q * v) * x + (p * v - q * u) * y) / (p * r - q * q) AS mean, (r * u * u - 2e0 * q * u * v + p * v * v) / (p * r - q * q) AS variance FROM p)"""


def _vectors(spark, d):
    return fx.read(spark, d, "embeddings").withColumn("stream", F.col("vec_id") % 4)


@query(f"WITH {RS} SELECT vec_id, {_fl('mean', 3)} AS mean, {_fl('variance', 3)} AS variance, {_fl('mean / sqrt(1e0 + variance)', 3)} AS z FROM m")
def record_small(spark, d):
    whole = lambda k: F.floor(F.get("embedding", k).cast("double") * 1000).cast("long")
    rows = _vectors(spark, d).select("vec_id", "stream", whole(0).alias("a"), whole(1).alias("b"), (F.col("label") % 3 == 0).cast("int").alias("y"))
    return record.small_record(rows, ["stream"], "vec_id", "a", "b", "y", digits=3).select("vec_id", "mean", "variance", "z")


def _record(**options):
    def run(spark, d):
        labels = F.array(*[((F.col("label") + p) % 3 == 0).cast("int") for p in range(fx.PEERS)])
        rows = _vectors(spark, d).select("stream", F.col("vec_id").alias("seq"), F.transform("embedding", lambda x: x.cast("double")).alias("address"), labels.alias("labels"), feedback(F.col("vec_id"), 0.5).alias("fed"))
        return record.fold(rows, "stream", **options)

    return run


QUERIES["record_full"] = _record()
QUERIES["record_sparse"] = _record(write="fed")
QUERIES["record_forgetting"] = _record(keep=0.99)
QUERIES["delta_rule"] = _record(rule="delta")


def _routing(spark, d):
    labels = F.array(*[((F.col("label") + p) % 3 == 0).cast("int") for p in range(fx.PEERS)])
    rows = fx.read(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), F.transform("embedding", lambda x: x.cast("double")).alias("address"), labels.alias("labels"))
    rows = rows.withColumn("rejected", F.transform("labels", lambda y: y == 0))
    n = rows.count()
    return rows.join(order.permutation(spark, n, "shuffled0"), "seq")


@query()
def policy_replay(spark, d):
    runs = [(p, m, 2, s) for p in replay.POLICIES for m in ("none", "all", "final") for s in (0, 1)]
    return replay.replay_metrics(replay.replay(_routing(spark, d), runs))


@query()
def budget_sweep(spark, d):
    runs = [(p, "all", k, 0) for p in ("memory", "success_counts") for k in range(1, fx.PEERS + 1)]
    return replay.replay_metrics(replay.replay(_routing(spark, d), runs))


# ---------------------------------------------------------------- scalars


@query(f"WITH {PR} SELECT id, peer, {_fl('ln(least(greatest(prob, 1e-6), 1 - 1e-6)) - ln(1 - least(greatest(prob, 1e-6), 1 - 1e-6))', 3)} AS odds, prob AS back, CAST(round_even(CAST(correct AS DOUBLE) / 2, 0) AS INTEGER) AS hard, {_fl('greatest(0e0, prob / 100e0 / greatest(0.001e0, 1e-12) - 1e0)', 3)} AS support FROM pr")
def scalar_mathematics(spark, d):
    rows = fx.estimates(spark, d)
    return rows.select("id", "peer", places(logit(F.col("prob")), 3).alias("odds"), places(inverse_logit(logit(F.col("prob"))), 4).alias("back"), hard_label(F.col("correct") / 2).alias("hard"), places(evidence(F.col("prob"), F.lit(0.001), 100.0), 3).alias("support"))


# ---------------------------------------------------------------- the relational core, over the star schema


@query("SELECT n_name, r_name, count(*) AS orders, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def star_join(spark, d):
    r = lambda t: fx.read(spark, d, t)
    by = r("orders").join(r("customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("orders"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("long").alias("finished"))
    out = by.join(r("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(r("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return out.groupBy("n_name", "r_name").agg(F.sum("orders").alias("orders"), F.sum("finished").alias("finished"))


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + 2 * grouping(l_linestatus) AS INTEGER) AS level, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def line_cube(spark, d):
    rows = fx.read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus")
    return rows.agg((F.grouping("l_returnflag") + 2 * F.grouping("l_linestatus")).cast("int").alias("level"), F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def latest_orders(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return fx.read(spark, d, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 2").select("o_custkey", "o_orderkey", "r")


@query("(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT s_suppkey FROM supplier INTERSECT SELECT l_suppkey FROM lineitem)")
def set_operations(spark, d):
    r = lambda t, c: fx.read(spark, d, t).select(F.col(c).alias("k"))
    return r("customer", "c_custkey").subtract(r("orders", "o_custkey")).unionAll(r("supplier", "s_suppkey").intersect(r("lineitem", "l_suppkey")))


# ---------------------------------------------------------------- reports, grading, addresses


@query(f"WITH {EV}, {OWN} SELECT {_fl('auc')} AS auc, {_fl('mean')} AS mean_estimate, {_fl('acc')} AS accuracy FROM ({_auc('op', 'own_prob', 'own_correct')}), (SELECT sum(CAST(round(own_prob * 10000) AS BIGINT)) / 1e4 / count(*) AS mean, CAST(sum(own_correct) AS DOUBLE) / count(*) AS acc FROM op)")
def own_quality(spark, d):
    rows = quality.running_accuracy(fx.own(spark, d).withColumn("k", F.lit(0)), ["k"], "own_prob", label="own_correct")
    ranked = quality.auc(rows, "own_prob", "own_correct", ["k"])
    mean = F.sum(F.round(F.col("own_prob") * 10000).cast("long")).cast("double") / F.lit(1e4) / F.count("*").cast("double")
    rest = rows.groupBy("k").agg(places(mean, 4).alias("mean_estimate"), places(F.sum("own_correct").cast("double") / F.count("*").cast("double"), 4).alias("accuracy"))
    return ranked.withColumn("auc", places(F.col("auc"), 4)).join(rest, "k").drop("k")


@query(f"WITH {EV}, {OWN} SELECT coalesce(CAST(source AS VARCHAR), 'all') AS source, CAST(grouping(source) AS INTEGER) AS overall, count(*) AS answers, 1e2 * CAST(sum(own_correct) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS accuracy FROM ow GROUP BY GROUPING SETS ((), (source))")
def answer_summary(spark, d):
    out = reports.answer_summary(fx.own(spark, d).withColumnRenamed("own_correct", "correct"))
    return out.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("all")))


@query(f"WITH {MI} SELECT task, CAST(grouping(task) AS INTEGER) AS overall, count(*) AS attempts, count(*) FILTER (usable) AS accepted_attempts, count(*) FILTER (forced) AS forced_attempts, count(*) FILTER (peer = 0) AS soft_attempts, 1e2 * CAST(count(*) FILTER (usable) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS usable_share FROM mi GROUP BY GROUPING SETS ((), (task))")
def acceptance_summary(spark, d):
    soft = F.when(F.col("peer") == 0, F.array(F.lit("ungrounded"))).otherwise(F.array().cast("array<string>"))
    return reports.acceptance_summary(fx.misleading(spark, d).withColumn("soft", soft).withColumnRenamed("usable", "accepted"))


@query(f"WITH {MI} SELECT reason, count(*) AS attempts FROM (SELECT unnest(CASE WHEN usable THEN [] WHEN forced THEN ['leak', 'format'] ELSE ['refusal'] END) AS reason FROM mi) GROUP BY reason")
def reason_histogram(spark, d):
    reasons = F.when(F.col("usable"), F.array().cast("array<string>")).when(F.col("forced"), F.array(F.lit("leak"), F.lit("format"))).otherwise(F.array(F.lit("refusal")))
    return reports.reason_histogram(fx.misleading(spark, d).withColumn("reasons", reasons))


@query("SELECT count(*) AS reports, 1e2 * CAST(sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS rejected FROM conversations")
def rejection_share(spark, d):
    said = F.when(F.col("turn") % 3 == 0, "Verdict: reject").otherwise("fine")
    return reports.rejection_share(fx.read(spark, d, "conversations").select(T.verdict(said).alias("verdict")))


@query("SELECT CAST(min(length(text)) AS INTEGER) AS least, CAST(floor(quantile_cont(length(text), 0.5)) AS BIGINT) AS median, CAST(max(length(text)) AS INTEGER) AS most FROM documents")
def prompt_lengths(spark, d):
    return reports.length_statistics(fx.read(spark, d, "documents"), "text", "doc_id")


@query(f"WITH {CH} SELECT id, peer, CASE WHEN g = 'key yes' THEN 1 ELSE 0 END AS correct FROM ch")
def task_grading(spark, d):
    rows = _choices(spark, d).drop("correct").withColumn("task_type", F.lit("boolqa")).withColumn("answer", F.lit("yes"))
    return tasks.graded(rows, "text").select("id", "peer", "correct")


@query(f"WITH {CH} SELECT id, peer, CASE WHEN g LIKE 'key %' THEN substr(g, 5) END AS key FROM ch")
def agreement_keys(spark, d):
    rows = _choices(spark, d).withColumn("task_type", F.lit("boolqa"))
    return tasks.agreement_keys(rows, "text").select("id", "peer", "key")


@query(f"WITH {CH} SELECT id, peer, g = 'key no' AS accepted, CASE g WHEN 'key yes' THEN 'still_correct' WHEN 'key no' THEN '' ELSE 'format' END AS reasons FROM ch")
def attempt_acceptance(spark, d):
    rows = _choices(spark, d).withColumn("task_type", F.lit("boolqa")).withColumn("answer", F.lit("yes")).withColumn("problem", F.lit("a question"))
    return tasks.acceptance(tasks.graded(rows.drop("correct"), "text"), "text", "target").select("id", "peer", "accepted", F.array_join("reasons", ",").alias("reasons"))


@query(f"SELECT event_id AS id, ['A', 'C', 'D'][1 + CAST(floor({u(chr(39) + 'mcqa|' + chr(39) + ' || event_id')} * 3) AS INTEGER)] AS wrong FROM events")
def wrong_labels(spark, d):
    rows = fx.events(spark, d).withColumns({"task_type": F.lit("mcqa"), "answer": F.lit("(b)"), "choices": F.array(*[F.lit(x) for x in "wxyz"])})
    return tasks.wrong_label(rows, "id").select("id", "wrong")


@query()
def address_projection(spark, d):
    rows = fx.read(spark, d, "embeddings")
    return addresses.fit(rows, "embedding", 16).apply(rows.select("vec_id", "embedding"), "embedding").select("vec_id", "address")


@query(f"WITH {EV}, {OWN}, g AS (SELECT id, own_correct, r FROM ow, (SELECT unnest([0.1e0, 0.5e0, 1e0]) AS r)), f AS (SELECT *, r >= 1 OR {u(chr(39) + '0:' + chr(39) + ' || id')} < r AS fed FROM g) SELECT r AS ratio, count(*) AS events, count(*) FILTER (fed) AS written, CAST(sum(CASE WHEN fed THEN own_correct ELSE 0 END) AS BIGINT) AS rights FROM f GROUP BY r")
def feedback_ratios(spark, d):
    rows = fx.own(spark, d)
    cols = F.array(*[F.struct(F.lit(r).alias("ratio"), feedback(F.col("id"), r).alias("fed")) for r in (0.1, 0.5, 1.0)])
    flat = rows.select("own_correct", F.explode(cols).alias("x")).select("own_correct", "x.*")
    return flat.groupBy("ratio").agg(F.count("*").alias("events"), F.sum(F.when(F.col("fed"), 1).otherwise(0)).cast("long").alias("written"), F.sum(F.when(F.col("fed"), F.col("own_correct")).otherwise(0)).cast("long").alias("rights"))
