import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.operators import arbitration, order, prefix, quality, record, regimes, replay, retrieval, streams, votes
from veritally.plans import registry, tables


def test_numbering_in_ranges_equals_one_sort(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), k) for k in range(500)]
    df = spark.createDataFrame(rows, "a long, b long")
    for size in (30, 10_000):
        got = sorted((r.a, r.b, r.seq) for r in order.numbered(df, ["a", "b"], bucket_rows=size).collect())
        assert [g[2] for g in got] == list(range(500)) and [g[:2] for g in got] == sorted(rows)


def test_numbering_in_ranges_of_times_without_a_zone_and_dates(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4000), k) for k in range(300)]
    # the clock of this zone skips an hour on this day, and the times differ by fractions of a second
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        for kind, step in (("timestamp_ntz", "make_dt_interval(0, 0, 0, a * 2.000001)"), ("timestamp", "make_dt_interval(0, 0, 0, a * 2.000001)"), ("date", "CAST(a AS INT)")):
            first = "DATE'2024-03-31'" if kind == "date" else f"{kind}'2024-03-31 01:00:00'"
            df = spark.createDataFrame(rows, "a long, b long").selectExpr("a", "b", f"{first} + {step} AS t")
            assert df.schema["t"].dataType.typeName() == kind
            got = sorted((r.a, r.b, r.seq) for r in order.numbered(df, ["t", "b"], bucket_rows=20).select("a", "b", "seq").collect())
            assert [g[2] for g in got] == list(range(300)) and [g[:2] for g in got] == sorted(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_numbered_ranges_feed_groups_of_a_derived_column(spark):
    """Nothing but the key and a label of the numbered rows is read on; their number is not."""
    df = spark.createDataFrame([(k * 7 % 300, k, "ab"[k % 2]) for k in range(300)], "a long, b long, g string").selectExpr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, a) AS t", "b", "g")
    out = order.numbered(df, ["t", "b"], bucket_rows=100)
    rows = out.select("b", "g", F.explode(F.array(F.lit(0), F.lit(1))).alias("p")).groupingSets([[], ["g"]], "g").agg(F.count("*").alias("n"))
    assert sorted((r.g or "", r.n) for r in rows.collect()) == [("", 600), ("a", 300), ("b", 300)]


def test_numbered_ranges_stay_in_several_tasks(spark):
    out = order.numbered(spark.range(400).withColumn("b", F.lit(0)), ["id", "b"], bucket_rows=50)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_ranges_are_found_by_halving(spark):
    values = [None, -np.inf, *np.arange(-2, 310, 0.5).tolist(), np.inf, np.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for cuts in ([4.0], [1.0, 2.0, 7.5], sorted(random.Random(1).sample(range(300), 150))):
        got = df.select("v", order._cuts_below(F.col("v"), [float(c) for c in cuts]).alias("n")).collect()
        assert all(r.n == (0 if r.v is None else sum(bool(np.isnan(r.v) or c < r.v) for c in cuts)) for r in got)
    # the value is computed once a row, not once a cut that it is compared with
    plan = df.select(order._cuts_below(F.col("v") + 0.25, [float(c) for c in range(1000)]).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("0.25") == 1


def test_bins_and_segments(spark):
    for n in (7, 24, 100):
        df = spark.range(n)
        got = [r[0] for r in df.select(order.equal_count_bin(F.col("id"), F.lit(n), 5), "id").orderBy("id").collect()]
        assert got == [next(b for b in range(5) if n * b // 5 <= k < n * (b + 1) // 5) for k in range(n)]
        cuts = [round(i * n / 8) for i in range(9)]
        got = [r[0] for r in df.select(order.segment(F.col("id"), n, 8), "id").orderBy("id").collect()]
        assert got == [max(b for b in range(8) if cuts[b] <= k) for k in range(n)]
    assert sorted(r.pos for r in order.permutation(spark, 9, "shuffled3").collect()) == list(range(9))


@pytest.mark.parametrize("block", [3, 1000])
def test_earlier_sums_do_not_depend_on_blocks(spark, block):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", None]), rng.randrange(9)) for k in range(60)]
    df = spark.createDataFrame(rows, "pos long, g string, v long")
    got = {r.pos: (r.s, r.n) for r in prefix.earlier_sums(df, ["g"], "pos", {"s": F.col("v"), "n": F.lit(1)}, block).collect()}
    assert got == {k: (sum(v for p, h, v in rows if h == g and p < k), sum(1 for p, h, _ in rows if h == g and p < k)) for k, g, _ in rows}


def test_auc_counts_ties_half_and_is_null_for_one_kind(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.randrange(6) / 5, rng.randrange(2)) for _ in range(200)] + [("one", 0.5, 1)]
    got = {r.g: r.auc for r in quality.auc(spark.createDataFrame(rows, "g string, s double, y int"), "s", "y", ["g"]).collect()}
    for g in "xyz":
        p, n = [s for h, s, y in rows if h == g and y], [s for h, s, y in rows if h == g and not y]
        assert got[g] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n)))
    assert got["one"] is None


def test_favourite_is_the_first_of_the_best(spark):
    df = spark.createDataFrame([(1, 0, 0.5, 0), (1, 1, 0.9, 1), (1, 2, 0.9, 0)], "id long, slot int, p double, y int")
    r = quality.favourite(df, "id", "slot", "p", "y").first()
    assert (r.favourite, r.favourite_right, r.n, r.rights) == (1, 1, 3, 1)


def test_plurality(spark):
    rows = [(1, k, g, y) for k, (g, y) in enumerate([("yes", 1)] * 3 + [("no", 0)] * 2 + [("", 0)])]
    rows += [(2, k, g, y) for k, (g, y) in enumerate([("yes", 1)] * 3 + [("no", 0)] * 3)] + [(3, k, None, y) for k, y in enumerate([1, 1, 0])]
    df = spark.createDataFrame(rows, "id long, slot int, a string, y int").withColumn("g", votes.group_key(F.col("a"), F.col("slot")))
    got = {r.id: (round(r.correct, 6), r.votes, r.tied) for r in votes.plurality(df, "id", "g", "y").collect()}
    assert got == {1: (1.0, 3, 1), 2: (0.5, 3, 2), 3: (round(2 / 3, 6), 1, 3)}


def test_exact_regimes_reach_the_rate_and_nest(spark):
    df = spark.range(100).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("peer")).withColumn("usable", F.col("id") % 4 != 0).withColumn("position", F.col("id") / 100).withColumn("correct", F.lit(1))
    chosen = lambda name: {(r.id, r.peer) for r in regimes.select_answers(df, regimes.shorthand(name), 100).filter("selected").collect()}
    sets = [chosen(f"p{r:03d}") for r in (0, 25, 50, 100)]
    assert [sum(1 for s in x if s[1] == 0) for x in sets] == [0, 25, 50, 75] and all(a <= b for a, b in zip(sets, sets[1:], strict=False))
    two = regimes.select_answers(df, regimes.Regime("k", "count", count=1, peers=(1,)), 100).filter("selected")
    assert two.filter("peer = 0 or not usable").count() == 0 and two.count() == 75
    assert regimes.shorthand("p101") is None and regimes.shorthand("x") is None
    with pytest.raises(ValueError, match="rate"):
        regimes.Regime("x", rate=2)


def test_reading_line_equals_the_sequential_fold(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "ab"[k % 2], round(float(rng.random()), 4), round(float(rng.random()), 4), int(rng.random() < 0.6)) for k in range(80)]
    df = spark.createDataFrame(rows, "seq long, task string, trust double, own_prob double, read_correct int")
    got = {r.seq: r for r in arbitration.reading_line(df, block=7).collect()}
    state = {t: (np.eye(2), np.array([0.5, 0.0])) for t in "ab"}
    for k, t, trust, own, y in rows:
        p, q = state[t]
        rho, delta = np.linalg.solve(p, q)
        assert (got[k].rho, got[k].delta) == pytest.approx((rho, delta), abs=1e-9)
        u = np.array([trust, trust - 1])
        state[t] = (p + np.outer(u, u), q + u * (y - (1 - trust) * own))
    three = spark.createDataFrame([(0, "x", 1.0, 0.3, 1), (1, "x", 1.0, 0.3, 0), (2, "x", 0.0, 0.8, 1)], df.schema)
    last = arbitration.final_lines(three).first()
    assert (last.rho, last.delta) == pytest.approx((0.5, -0.1)) and last.events == 3


def test_posterior_is_the_closed_form_and_order_free():
    rng = np.random.default_rng(5)
    x, s = rng.normal(size=(40, 6)), rng.choice([-1.0, 0.0, 1.0], (40, 2))
    for keep in (1.0, 0.9):
        a, b = record.Posterior(6, 2, 3.0, keep), record.Posterior(6, 2, 3.0, keep)
        for k in range(40):
            a.write(x[k], s[k])
        for k in reversed(range(40)):
            b.write(x[k], s[k])
        if keep == 1:
            mean, var = a.read(x[:3])
            full = np.linalg.inv(3 * np.eye(6) + x.T @ x)
            assert np.allclose(mean, x[:3] @ full @ (x.T @ s)) and np.allclose(var, np.einsum("ij,jk,ik->i", x[:3], full, x[:3]))
            assert np.allclose(a.read(x)[0], b.read(x)[0])
        c = record.Posterior(6, 2, 3.0, keep)
        c.restore(a.snapshot())
        assert np.allclose(c.read(x)[0], a.read(x)[0])
    cold = record.Posterior(3)
    assert record.probability(*[v.ravel() for v in cold.read(np.ones(3))]) == pytest.approx([0.5])
    with pytest.raises(ValueError, match="posterior"):
        record.Posterior(3, keep=0)


def test_fold_reads_before_it_writes_and_skips_unwritten(spark):
    rng = np.random.default_rng(6)
    rows = [(k % 2, k, rng.normal(size=3).tolist(), [int(v) for v in rng.integers(0, 2, 2)], bool(k % 3)) for k in range(30)]
    df = spark.createDataFrame(rows, "g long, seq long, address array<double>, labels array<int>, fed boolean")
    for rule in ("posterior", "delta"):
        got = {r.seq: r.mean for r in record.fold(df, "g", write="fed", rule=rule).collect()}
        for g in (0, 1):
            state = record.Posterior(4, 2) if rule == "posterior" else record.DeltaRule(4, 2)
            for _, k, a, y, fed in (r for r in rows if r[0] == g):
                assert got[k] == pytest.approx(state.read(np.append(a, 1))[0][0].tolist())
                if fed:
                    state.write(np.append(a, 1), 2 * np.array(y) - 1)


def test_designs():
    q, c = np.array([1.0, 2.0]), np.arange(6.0).reshape(2, 3)
    for design in ("q", "c", "cm", "qc", "qcm"):
        rows = record.design_rows(design, q, c, [0.1, 0.2], [2, 0], 3)
        assert rows.shape == (1 if design == "q" else 2, record.design_size(design, 3, 2, 3))
    assert record.design_rows("qc", q, c, [0, 0], [2, 0], 3)[0].tolist() == [0, 0, 0, 0, 1, 2, 0, 1, 2, 1]


def test_routing_with_memory_beats_counts_beats_chance(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(400):
        kind = int(rng.integers(3))
        good = [float(rng.random() < (0.9 if s == kind else 0.2 + 0.1 * s)) for s in range(3)]
        address = [3.0 * (kind == j) for j in range(3)]
        rows.append((k, k, address, [int(g) for g in good], [not g for g in good]))
    df = spark.createDataFrame(rows, "seq long, pos long, address array<double>, labels array<int>, rejected array<boolean>")
    got = {r.policy: r.accuracy for r in replay.replay_metrics(replay.replay(df, [(p, "none", 1, 0) for p in replay.POLICIES])).collect()}
    assert got["memory"] > 0.75 > got["success_counts"] >= got["random"] - 0.05
    asked = replay.replay(df, [("random", "all", 3, 0)]).agg(F.max("used"), F.min("hit")).first()
    assert asked[0] <= 3


def test_streams(spark):
    events = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    rows = spark.createDataFrame([(1, "p", "x", 1), (1, "q", "y", 0), (2, "p", "z", 1)], "id long, peer string, response string, correct int")
    assert [(r.id, r.responses) for r in streams.add_answers(events, rows, ["p", "q"]).collect()] == [(1, {"p": "x", "q": "y"})]
    assert {r.peer: r.dropped for r in streams.missing_answers(events, rows, ["p", "q"]).collect()} == {"p": 1, "q": 2}
    assert {r.id: r.response for r in streams.last_wins(rows, "id", ["peer"]).collect()} == {1: "y", 2: "z"}


def test_bm25_of_a_tiny_corpus(spark):
    docs = spark.createDataFrame([(0, "the cat sat"), (1, "cat cat dog"), (2, "a bird"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "Cat bird cat")], "item_id long, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25(docs, asked).collect()}
    idf = lambda df: np.log(1 + (4 - df + 0.5) / (df + 0.5))
    w = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 1.5))
    assert got == pytest.approx({0: 2 * w(1, 2) * idf(2), 1: 2 * w(2, 3) * idf(2), 2: w(1, 1) * idf(1)}, abs=1e-3)
    assert [r.doc_id for r in retrieval.top(retrieval.bm25(docs, asked), "item_id", "doc_id", 1).collect()] == [1]


def test_registry_and_jobs(tmp_path):
    for kind, name, text in [("tasks", "qa", "{}"), ("models", "m", "{}"), ("peers", "p", '{"model": "m"}'), ("datasets", "_t", '{"task": "qa", "path": "{name}.jsonl"}'), ("datasets", "d", '{"include": "_t", "peers": ["p"]}'), ("groups", "g", '{"members": ["d", "h"]}'), ("groups", "h", '{"members": ["d"]}')]:
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / f"{name}.json").write_text(text)
    r = registry.Registry.scan(tmp_path)
    assert r.get("datasets", "d") == {"task": "qa", "path": "d.jsonl", "peers": ["p"]} and r.problems() == [] and r.expand(["g", "d"]) == ["d"]
    with pytest.raises(KeyError, match="close: d"):
        r.get("datasets", "dd")
    r.entities["peers"]["x"] = {"model": "none"}
    assert r.problems() == ["peer x: model 'none' is not in models"]
    ran = []
    jobs = [registry.Job("b", ("a",), lambda: ran.append("b")), registry.Job("a", (), lambda: ran.append("a")), registry.Job("c", (), lambda: ran.append("c"), lambda: True)]
    assert [[j.name for j in w] for w in registry.waves(jobs)] == [["a", "c"], ["b"]] and registry.execute(jobs) == {"a": "ran", "c": "kept", "b": "ran"} and ran == ["a", "b"]
    with pytest.raises(ValueError, match="wait for each other"):
        registry.waves([registry.Job("a", ("b",)), registry.Job("b", ("a",))])
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}}')
    (tmp_path / "top.json").write_text('{"base": "base.json", "a": {"y": 3}}')
    assert registry.load_config(tmp_path / "top.json", {"a.z.w": 4}) == {"a": {"x": 1, "y": 3, "z": {"w": 4}}}
    assert registry.stale({"a": 1, "b": 2}, {"b": 3, "c": 1}) == "b: 2 stored, 3 wanted"


def test_tables(spark):
    df = spark.createDataFrame([("s", "tilt", 0.766), ("s", "solo", 0.692), ("t", "solo", 0.5)], "stream string, condition string, accuracy double")
    got = {r.stream: (r.tilt, r.solo) for r in tables.pivoted(df, "stream", "condition", "accuracy", ["tilt", "solo"]).collect()}
    assert got == {"s": (" 76.6", " 69.2"), "t": ("-", " 50.0")}
    assert {r.stream: r.difference for r in tables.difference(df, "stream", "condition", "accuracy", "tilt", "solo").collect()} == {"s": "+7.4", "t": "-"}
    assert tables.markdown(df.limit(0)).count("\n") == 1


def test_team_builds_hops_and_views(spark):
    from veritally.operators import team

    rows = [("q1", "Who?", "b", ["bb"], [("T1", "alpha beta", True), ("T2", "gamma delta", False)], [("Where is alpha", "beta", 0), ("#1 >> delta", "b", 1)])]
    schema = "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<title:string,paragraph_text:string,is_supporting:boolean>>, question_decomposition array<struct<question:string,answer:string,paragraph_support_idx:int>>"
    q = spark.createDataFrame(rows, schema)
    hops = team.hops(q)
    assert [(r.id, r.problem, r.answer_aliases, r.last) for r in hops.orderBy("sub_task").collect()] == [("q1/h1", "Where is alpha", [], False), ("q1/h2", "What is the 'delta' of beta?", ["bb"], True)]
    docs = team.paragraphs(q)
    assert docs.count() == 2
    for k, local, found in ((1, True, 1), (2, True, 2), (3, False, 2)):
        r = team.support_found(hops, team.retrieved(hops, docs, k, local)).first()
        assert (r.hops, r.found >= found) == (2, True)


def test_projection_is_the_principal_components(spark):
    from veritally.operators import addresses

    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) + 3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(200, None)], "k long, f array<double>").repartition(3)
    p = addresses.fit(df, "f", 2)
    z = (x - x.mean(0)) / (x.std(0, ddof=1) + 1e-3)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(p.basis.T @ v[:2].T), np.eye(2), atol=1e-6)
    got = {r.k: r.address for r in p.apply(df, "f").collect()}
    assert got[200] is None and np.allclose(np.std([got[k] for k in range(200)]), 1, atol=0.01)


def test_lengths_are_of_the_whole_table(spark):
    from veritally.operators import reports

    rows = spark.createDataFrame([(k, "x" * k) for k in range(1, 1002)], "id long, text string")
    assert tuple(reports.length_statistics(rows, "text", "id").first()) == (1, 501, 1001)
    assert tuple(reports.length_statistics(rows, "text", "id", 4).first()) == (1, 2, 3)


def test_reports(spark):
    from veritally.operators import reports

    a = spark.createDataFrame([("s", 1, 2, [(False,), (True,)], True, False, [], ["x"]), ("t", 0, 1, [], False, True, ["leak"], [])], "source string, correct int, turns int, visible array<struct<passed:boolean>>, accepted boolean, forced boolean, reasons array<string>, soft array<string>")
    assert {r.source: r.accuracy for r in reports.answer_summary(a).collect()} == {None: 50.0, "s": 100.0, "t": 0.0}
    r = reports.turn_statistics(a).first()
    assert (r.mean_turns, r.passed_first, r.passed_last) == (1.5, 0.0, 50.0)
    assert {r.turns: r.accuracy for r in reports.rights_by_turns(a).collect()} == {2: 100.0, 1: 0.0}
    s = reports.acceptance_summary(a, "source").filter("overall = 1").first()
    assert (s.attempts, s.accepted_attempts, s.forced_attempts, s.soft_attempts) == (2, 1, 1, 1)
    assert {r.reason: r.attempts for r in reports.reason_histogram(a).collect()} == {"leak": 1}
    old = spark.createDataFrame([("a", "rag", 0), ("b", "code", 1)], "id string, task_type string, correct int")
    new = spark.createDataFrame([("a", 1), ("b", 0)], "id string, correct int")
    assert {r.id: (r.before, r.correct) for r in reports.regraded(old, new).collect()} == {"a": (0, 1), "b": (1, 1)}
