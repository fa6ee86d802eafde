"""Symbolic equality: written forms, a property test against exact evaluation, and what is not read."""

from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritally.functions import symbolic

EQUAL = [
    ("10-4n", "-4n+10"), ("3^6", "729"), ("4,7", "x=4 or x=7"), (r"\frac12", "0.5"), (r"\frac{\sqrt{3}}{3}", r"\frac{1}{\sqrt3}"), ("(x+1)^2", "x^2+2x+1"), ("13-8 i", "13-8i"), ("(2+i)(2-i)", "5"),
    ("[0,1)", r"\left[0, \frac{2}{2}\right)"), (r"\{1,2\}", r"\{2,1\}"), (r"2\pm\sqrt{3}", r"2-\sqrt3, 2+\sqrt3"), ("y=2x+1", "2x+1"), ("2y=4x+2", "y-2x=1"), ("1,234", "1234"), (r"50\%", "0.5"),
    (r"2\frac{1}{2}", "5/2"), (r"\sqrt[3]{8}", "2"), (r"\sqrt{3+2\sqrt2}", r"1+\sqrt2"), ("2^{n+1}", r"2\cdot 2^n"), ("5!", "120"), (r"(0,1)\cup(2,3)", r"(2,3)\cup(0,1)"), (r"30^\circ", "30"),
    ("-x^2", "-(x^2)"), (r"\pi r^2", r"r^2\pi"), ("|x|", r"\sqrt{x^2}"), (r"\frac{x^2-1}{x-1}", "x+1"), (r"5 \text{ cm}", "5"), ("x_1+x_2", "x_2+x_1"), ("1/2x", "x/2"), ("x^{-1}", "1/x"),
]
DIFFERENT = [
    ("(x+1)^2", "x^2+1"), ("(0,1)", "[0,1]"), ("(1,2)", "(2,1)"), (r"\{1,2\}", r"\{1,3\}"), ("x", "y"), ("-2^2", "4"), ("1/3", "0.333"), ("2y=4x+2", "y-2x=2"), ("1,2", "1,2,3"), ("(1,2,3)", "(1,2)"), (r"\sqrt2", "1.41421356"),
]
UNREAD = ["", r"\log 2", "5^{2^{303}-1}", r"\sum_k k", "1/0", "(10^{100})!", r"\sqrt{-1}", "a" * 300, "x=", "((", "no solution!?", "(" * 199, r"\frac", "9^{9^9}", "0^{-1}", None]


@pytest.mark.parametrize(("a", "b"), EQUAL)
def test_equal(a, b):
    assert symbolic.symbolic_equal(a, b) and symbolic.symbolic_equal(b, a)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert not symbolic.symbolic_equal(a, b) and not symbolic.symbolic_equal(b, a)


@pytest.mark.parametrize("text", UNREAD)
def test_what_cannot_be_read_equals_nothing(text):
    assert not symbolic.symbolic_equal(text, text) and not symbolic.symbolic_equal(text, "1")


def test_verified_falls_back_to_significant_figures():
    assert symbolic.verified("1.57", "1.6") and not symbolic.verified("1.5", "1.6") and symbolic.verified("x+x", "2x")
    assert symbolic.answers_agree("So the final answer is \\boxed{-4n+10}.", "10-4n") and not symbolic.answers_agree("\\boxed{4n}", "10-4n")


LEAF = st.one_of(st.integers(0, 20).map(lambda n: (str(n), lambda x, y, n=n: Fraction(n))), st.sampled_from([("x", lambda x, y: x), ("y", lambda x, y: y)]))


def combine(parts):
    def of(pair):
        (a, f), (b, g), op = pair
        return {
            "+": (f"({a} + {b})", lambda x, y: f(x, y) + g(x, y)),
            "-": (f"({a} - {b})", lambda x, y: f(x, y) - g(x, y)),
            "*": (f"({a})({b})", lambda x, y: f(x, y) * g(x, y)),
            "/": (rf"\frac{{{a}}}{{{b} + 21 + x^2}}", lambda x, y: f(x, y) / (g(x, y) + 21 + x * x)),
            "^": (f"({a})^2", lambda x, y: f(x, y) ** 2),
        }[op]

    return st.tuples(parts, parts, st.sampled_from("+-*/^")).map(of)


@settings(max_examples=150, deadline=None)
@given(st.recursive(LEAF, combine, max_leaves=6), st.recursive(LEAF, combine, max_leaves=6))
def test_verdicts_are_those_of_exact_evaluation(a, b):
    """Small expressions that agree at 40 points of a grid are the same."""
    (s, f), (t, g) = a, b
    points = [(Fraction(3 * k + 1, 7), Fraction(5 * k * k + 2, 11)) for k in range(40)]

    def values(h):
        out = []
        for p in points:
            try:
                out.append(h(*p))
            except ZeroDivisionError:
                out.append(None)
        return out

    if len(s) <= symbolic.LONGEST and len(t) <= symbolic.LONGEST:
        u, v = values(f), values(g)
        if None not in u + v:
            assert symbolic.symbolic_equal(s, t) == (u == v)
            assert symbolic.symbolic_equal(s, f"{t} - {t} + ({s})") or len(s) + 2 * len(t) > 180


def test_udf(spark):
    rows = [(k, a, b) for k, (a, b) in enumerate(EQUAL + DIFFERENT)] + [(99, None, "1")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = {r.k: r.same for r in df.select("k", symbolic.symbolic_equal_udf("a", "b").alias("same")).collect()}
    assert got == {k: k < len(EQUAL) for k, *_ in rows}
    assert df.filter("k = 1").select(symbolic.answers_agree_udf("a", "b")).first()[0]
