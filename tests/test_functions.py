import hashlib
import math

import pytest
from pyspark.sql import functions as F

from veritally.functions import answers as A
from veritally.functions import maths as M
from veritally.functions import text as T
from veritally.functions.hashing import feedback, stable_fraction


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


def test_hash_fractions_are_those_of_sha256_and_masks_nest(spark):
    rows = spark.range(500).select("id", stable_fraction("lab", 3, F.col("id")).alias("u"), *[feedback(F.col("id"), r, 5).alias(f"m{k}") for k, r in enumerate((0, 0.1, 0.4, 1))]).collect()
    for r in rows:
        assert r.u == int.from_bytes(hashlib.sha256(f"lab|3|{r.id}".encode()).digest()[:8], "big") / 2**64
        assert not r.m0 and r.m3 and (r.m2 or not r.m1)
    assert 0.3 < sum(r.m2 for r in rows) / 500 < 0.5


@pytest.mark.parametrize(("text", "want"), [("The  Cat, a dog!", "cat dog"), ("añ a-b", "añ ab"), ("", ""), (None, ""), ("an\ta the\n", "")])
def test_qa_normalise(spark, text, want):
    assert one(spark, T.qa_normalise(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("I think.\nAnswer: Paris.", "Paris"), ("Final answer is: 5\nthanks", "5"), ("Answer:\nRome.", "Rome"), ("Rowan Blanchard\n:", "Rowan Blanchard"), ("x\n[", "x"), ("", ""), ("...", "")],
)
def test_qa_answer(spark, text, want):
    assert one(spark, T.qa_answer(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("Final answer: no", "no"), ("yes, but answer is TRUE", "yes"), ("therefore, no", "no"), ("eyes", ""), ("", ""), ("answer: false. yes", "no")])
def test_yes_no_answer(spark, text, want):
    assert one(spark, T.yes_no_answer(F.col("t")), t=text) == want


@pytest.mark.parametrize(("p", "g", "want"), [("Seine River.", "Seine", 2 / 3), ("near the Seine in central Paris today", "Seine", 2 / 7), ("", "the", 1.0), ("a", "b", 0.0), ("x x y", "x y y", 2 / 3)])
def test_token_f1_counts_with_multiplicity(spark, p, g, want):
    assert one(spark, T.token_f1(F.col("p"), F.col("g")), p=p, g=g) == pytest.approx(want)


def test_verdicts_and_critiques(spark):
    t = "Verdict: accept\nverdict : ** REJECT\nCritique:  too short \nmore"
    assert one(spark, T.verdict(F.col("t")), t=t) == "REJECT" and one(spark, T.critique(F.col("t")), t=t) == "too short"
    assert one(spark, T.verdict(F.col("t")), t="fine") == "ACCEPT" and one(spark, T.verdict(F.col("t")), t=None) == "ACCEPT"


def test_faults(spark):
    assert one(spark, T.looped(F.col("t")), t="so " + "word " * 10) and not one(spark, T.looped(F.col("t")), t="0 " * 40)
    assert one(spark, T.looped(F.col("t")), t=" ".join(["that", f"{'x'}"] * 40)) and not one(spark, T.looped(F.col("t")), t="")
    assert one(spark, T.off_topic(F.col("t"), F.col("s")), t="def solve(x):\n    return x + 1 + 2", s="weather") and not one(spark, T.off_topic(F.col("t"), F.col("s")), t="(B)", s="weather")
    assert one(spark, T.leaks_gold(F.col("t"), F.col("g")), t="The correct answer is Paris.", g=["paris"]) and not one(spark, T.leaks_gold(F.col("t"), F.col("g")), t="It is Paris.", g=["paris"])
    assert one(spark, T.refuses(F.col("t")), t="I cannot help with that") and not one(spark, T.refuses(F.col("t")), t="I can help")


def test_blocks_clips_and_questions(spark):
    assert one(spark, T.peer_block(F.col("t")), t="<think>a</think> b ") == "b"
    assert one(spark, T.peer_block(F.col("t")), t="<think>a").endswith("no final answer]")
    assert one(spark, T.clip(F.col("t"), 4), t=" ab cd ") == "ab c ..." and one(spark, T.clip(F.col("t"), 9), t=" ab ") == "ab"
    assert one(spark, T.filled_question(F.col("t"), F.col("a")), t="Where is #1 of #12, #2?", a=["a$1", "b\\"]) == "Where is a$1 of #12, b\\?"
    assert one(spark, T.filled_question(F.col("t"), F.col("a")), t="#1 >> capital", a=["France"]) == "What is the 'capital' of France?"
    assert one(spark, T.wrong_number(F.col("g"), F.col("b")), g="42", b="so 6 * 7 = 42") == "7" and one(spark, T.wrong_number(F.col("g"), F.col("b")), g="42", b="") == "46"


def test_numbers(spark):
    assert [one(spark, M.hard_label(F.col("x")), x=v) for v in (0.5, 0.51, 1.0, 0.49)] == [0, 1, 1, 0]
    assert one(spark, M.normal_cdf(F.col("x")), x=1.0) == pytest.approx(0.5 * (1 + math.erf(2**-0.5)))
    when = lambda o, r, d: one(spark, M.reads_when(F.col("o"), F.col("r"), F.col("d")), o=o, r=r, d=d)
    assert [when(0.6, 0.9, 0.3), when(0.7, 0.5, 0.1), when(0.6, 0.9, -0.2), when(0.6, 0.4, -0.2)] == ["T >= 0.50", "never", "always", "T <= 0.50"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("so \\boxed{\\frac{\\sqrt{3}}{3}}", "\\frac{\\sqrt3}{3}"), ("\\boxed{No solution}", "nosolution"), ("#### 1,234", "1234"), ("The answer is 5.4 \\text{ cents}", "5.4"), ("Final Answer:\n\\[ x = 7 \\]", "x=7"), ("I get 42 after all that work", "42"), ("(-1, 6)", "(-1,6)"), ("", ""), (None, ""), ("30^\\circ", "30")],
)
def test_final_answers(text, want):
    assert A.final_answer(text) == want


def test_equality_groups_options_code():
    assert A.math_equal("\\frac{1}{2}", "0.5") and not A.math_equal("1/3", "0.3") and not A.math_equal("", "1")
    assert A.significant_equal("3.14", "3.1416") and not A.significant_equal("3", "4")
    assert A.leaders(["1", "2", "1.00001", None, "", "2.0"]) == [0, 1, 0, 2, 3, 1]
    assert A.option("I pick (B).\nFinal answer: (C)", ["A", "B", "C"]) == "C" and A.option("option b", ["A", "B"]) == "B" and A.option("", ["A"]) == ""
    assert A.code_block("x\n```python\nprint(1)\n```\ny") == "print(1)" and A.code_block("a ```\nz = 1\n``` b") == "z = 1" and A.code_block("raw") == "raw"
    assert A.boxed("boxed{a{b}c} \\boxed{open") is None and A.boxed("\\boxed{a{b}c}") == "a{b}c"
