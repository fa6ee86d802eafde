r"""Symbolic equality of stated answers: a small reader of formulas, and identity tests.

`value` reads an answer as an expression, an equation, a sequence in brackets (tuple or interval), a set, or a union. An expression is a tree of
tuples over numbers, names, sums, products, quotients, powers, roots, absolute values and factorials. Two expressions are equal if they agree at
chosen points: rational ones modulo a prime of 64 bits, where `i` is a root of -1 (two different rational functions of degree d agree at a point with
probability d / 2 ** 64), others (roots, moduli, names in exponents) as decimals of 60 digits at points between 1 and 2. The points follow from the names, so
a verdict is always the same. Everything else is compared part by part: sequences in order and with their brackets, sets in any order, equations up to a factor.

What cannot be read is equal to nothing: other commands (sums, integrals, limits, logarithms, trigonometric functions), words, more than
`LONGEST` characters, exponents and factorials beyond `MOST`. So the work of a pair is bounded, and no pair needs a time limit.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from decimal import Context, Decimal, DecimalException
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .answers import locate, math_equal, significant_equal

LONGEST, MOST, POINTS = 200, 1000, 3
PRIME = (1 << 64) - 59
_I = next(r for r in (pow(g, (PRIME - 1) // 4, PRIME) for g in range(2, 100)) if r * r % PRIME == PRIME - 1)
_REAL = Context(prec=60, Emax=10**6, Emin=-(10**6))
_NEAR = Decimal(10) ** -40

# How signs are also written, and commands that are names.
SAME = {
    "\\left": "", "\\right": "", "\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\cdot": "*", "\\times": "*", "\\div": "/", "\\$": "", "$": "",
    "^\\circ": "", "^{\\circ}": "", "\\%": "%", "\\,": "", "\\!": "", "\\;": "", "\\:": "", "\\ ": " ", "\\quad": " ", "\\qquad": " ",
    "\\lvert": "|", "\\rvert": "|", "×": "*", "÷": "/", "−": "-", "±": "\\pm", "∪": "\\cup", "π": "\\pi ", "√": "\\sqrt ",
}
NAMES = ("alpha", "beta", "gamma", "delta", "theta", "lambda", "mu", "pi", "rho", "sigma", "phi", "omega")

_TOKEN = re.compile(r"\s*(\d+(?:\.\d+)?|\.\d+|\\[A-Za-z]+|\\[{}]|[A-Za-z]|[-+*/^_()\[\]{}|!%])")
_TEXT = re.compile(r"\\(?:text|mathrm|mbox)\s*\{([^{}]*)\}")
_OR = re.compile(r"(?:\s|^)(?:or|and)(?:\s|$)|;")
_GROUPED = re.compile(r"(?<=\d),(?=\d{3}(?:\D|$))")
_PAIRS = {"(": ")", "[": "]", "{": "}"}


class Unreadable(ValueError):
    """The text, or what it asks to compute, is beyond this reader."""


class _Reader:
    """Recursive descent over the tokens of an expression."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise Unreadable(text)
            self.tokens.append(m[1])
            at = m.end()
        self.tokens.reverse()

    def next(self) -> str:
        return self.tokens[-1] if self.tokens else ""

    def take(self, *wanted: str) -> str:
        if not self.tokens or (wanted and self.tokens[-1] not in wanted):
            raise Unreadable(self.next())
        return self.tokens.pop()

    def whole(self) -> tuple:
        out = self.sum()
        if self.tokens:
            raise Unreadable(self.next())
        return out

    def sum(self) -> tuple:
        out = self.product()
        while self.next() in ("+", "-"):
            out = ("+" if self.take() == "+" else "-", out, self.product())
        return out

    def product(self) -> tuple:
        out = self.signed()
        while self.next():
            if self.next() in ("*", "/"):
                out = (self.take(), out, self.signed())
            elif self.next()[0].isalnum() or self.next()[0] in ".({\\" and self.next() not in ("\\}",):
                out = ("*", out, self.power())
            else:
                break
        return out

    def signed(self) -> tuple:
        if self.next() in ("+", "-"):
            return ("-", ("number", Fraction(0)), self.signed()) if self.take() == "-" else self.signed()
        return self.power()

    def power(self) -> tuple:
        out = self.atom()
        while self.next() in ("!", "%", "^"):
            mark = self.take()
            if mark == "^":
                return ("^", out, self.signed() if self.next() in ("+", "-") else self.power())
            out = ("!", out) if mark == "!" else ("/", out, ("number", Fraction(100)))
        return out

    def atom(self) -> tuple:
        t = self.take()
        if t[0].isdigit() or t[0] == ".":
            if self.next() == "\\frac":  # a mixed number
                part = self.atom()
                if part[1][0] == part[2][0] == "number":
                    return ("+", ("number", Fraction(t)), part)
                return ("*", ("number", Fraction(t)), part)
            return ("number", Fraction(t))
        if t in _PAIRS:
            out = self.sum()
            self.take(_PAIRS[t])
            return out
        if t == "|":
            out = self.sum()
            self.take("|")
            return ("abs", out)
        if t == "\\frac":
            over = self.argument()
            return ("/", over, self.argument())
        if t == "\\sqrt":
            degree = ("number", Fraction(2))
            if self.next() == "[":
                self.take()
                degree = self.sum()
                self.take("]")
            return ("root", degree, self.argument())
        if t.isalpha() or t[1:] in NAMES:
            if self.next() == "_":
                self.take()
                t += f"_{self.argument()}"
            return ("name", t)
        raise Unreadable(t)

    def argument(self) -> tuple:
        """What a command applies to: a group, or one sign."""
        if self.next() and self.next()[0].isdigit() and len(self.next()) > 1:
            digits = self.take()
            self.tokens.append(digits[1:])
            return ("number", Fraction(digits[0]))
        return self.atom()


class _Real(Exception):
    """Needs real numbers: there is none such modulo the prime."""


def constant(tree: tuple) -> int | Fraction:
    """A tree without names, computed exactly."""
    kind, *parts = tree
    if kind == "number":
        return parts[0]
    if kind in "+-*/" and len(parts) == 2:
        a, b = map(constant, parts)
        if kind == "/" and not b:
            raise Unreadable("division by 0")
        return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b
    raise _Real


def _counted(tree: tuple) -> int:
    n = constant(tree)
    if n.denominator != 1 or not 0 <= n <= MOST:
        raise Unreadable("no small whole number")
    return int(n)


def modular(tree: tuple, point: Callable[[str], int]) -> int:
    kind, *parts = tree
    if kind == "number":
        return parts[0].numerator * pow(parts[0].denominator, -1, PRIME) % PRIME
    if kind == "name":
        return _I if parts[0] == "i" else point(parts[0])
    if kind == "!":
        return math.factorial(_counted(parts[0])) % PRIME
    if kind in ("root", "abs"):
        raise _Real
    a = modular(parts[0], point)
    if kind == "^":
        n = constant(parts[1])
        if n.denominator != 1:
            raise _Real
        if abs(n) > MOST:
            raise Unreadable("exponent")
        return pow(a, int(n), PRIME)  # a ValueError if 0 has no inverse
    b = modular(parts[1], point)
    return (a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a * pow(b, -1, PRIME)) % PRIME


def real(tree: tuple, point: Callable[[str], Decimal]) -> Decimal:
    kind, *parts = tree
    if kind == "number":
        return _REAL.divide(Decimal(parts[0].numerator), Decimal(parts[0].denominator))
    if kind == "name":
        return point(parts[0])
    if kind == "!":
        return Decimal(math.factorial(_counted(parts[0])))
    if kind == "abs":
        return abs(real(parts[0], point))
    if kind == "root":
        n = _counted(parts[0])
        a = real(parts[1], point)
        if n == 2:
            return _REAL.sqrt(a)
        if not n or (a < 0 and n % 2 == 0):
            raise Unreadable("root")
        return _REAL.copy_sign(_REAL.power(abs(a), _REAL.divide(1, n)), a) if a else a
    a, b = (real(p, point) for p in parts)
    if kind == "^":
        if abs(b) > MOST:
            raise Unreadable("exponent")
        return _REAL.power(a, b)
    return {"+": _REAL.add, "-": _REAL.subtract, "*": _REAL.multiply, "/": _REAL.divide}[kind](a, b)


def _number(name: str, k: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{k}|{name}".encode()).digest()[:8], "big")


def _values(trees: list[tuple]) -> tuple[list[list], bool]:
    """The values of the trees at each point, and whether they are exact."""
    try:
        return [[modular(t, lambda n, k=k: _number(n, k) % PRIME) for t in trees] for k in range(POINTS)], True
    except _Real:
        return [[real(t, lambda n, k=k: 1 + _REAL.divide(_number(n, k), 1 << 64)) for t in trees] for k in range(POINTS)], False


def _same(x, y, exact: bool) -> bool:
    return x == y if exact else abs(x - y) <= _NEAR * max(1, abs(x), abs(y))


def same_expression(a: tuple, b: tuple) -> bool:
    points, exact = _values([a, b])
    return all(_same(x, y, exact) for x, y in points)


def same_equation(a: tuple, b: tuple) -> bool:
    """Whether one difference of sides is a multiple of the other, not by 0."""
    points, exact = _values([a, b])
    (x, y), *others = points
    if exact:
        return all((u == 0) == (v == 0) and (x * v - u * y) % PRIME == 0 for u, v in points) and any(u for u, _ in points)
    return all(_same(x * v, u * y, exact) for u, v in others) and any(u and v for u, v in points)


def _parts(text: str, at: re.Pattern) -> list[str]:
    """The text cut where the pattern matches outside brackets."""
    out, depth, last, place = [], 0, 0, 0
    while place < len(text):
        c = text[place]
        depth += (c in "([{") - (c in ")]}")
        m = at.match(text, place) if depth == 0 else None
        if m and m.end() > place:
            out.append(text[last:place])
            last = place = m.end()
        else:
            place += 1
    return [*out, text[last:]]


def _spelled(text: str) -> str:
    text = _TEXT.sub(lambda m: f" {m[1].strip()} " if m[1].strip() in ("or", "and") else " ", text)
    for written, plain in SAME.items():
        if written[0] == "\\" and written[-1].isalpha():
            text = re.sub(re.escape(written) + r"(?![A-Za-z])", lambda m, p=plain: p, text)
        else:
            text = text.replace(written, plain)
    return _GROUPED.sub("", text).strip().rstrip(".").strip()


@lru_cache(4096)
def value(text: str) -> tuple:
    """("expression", tree), ("equation", left - right), ("sequence", open, close, values), ("set", values) or ("union", values)."""
    if len(text) > LONGEST:
        raise Unreadable("long")
    return _value(_spelled(text))


def _value(text: str) -> tuple:
    text = text.strip()
    if re.search(r"\\pm(?![A-Za-z])", text):
        signs = [re.sub(r"\\mp(?![A-Za-z])", "-" if s == "+" else "+", re.sub(r"\\pm(?![A-Za-z])", s, text)) for s in "+-"]
        return ("set", tuple(map(_value, signs)))
    joined = _parts(text, re.compile(r"\\cup(?![A-Za-z])"))
    if len(joined) > 1:
        return ("union", tuple(map(_value, joined)))
    listed = [x for part in _parts(text, _OR) for x in _parts(part, re.compile(","))]
    if len(listed) > 1:
        return ("set", tuple(map(_value, listed)))
    if text.startswith("\\{") and text.endswith("\\}"):
        return ("set", tuple(map(_value, _parts(text[2:-2], re.compile(",")))))
    if text[:1] in ("(", "[") and text[-1:] in (")", "]"):
        items = _parts(text[1:-1], re.compile(","))
        if len(items) > 1:
            return ("sequence", text[0], text[-1], tuple(map(_value, items)))
    sides = _parts(text, re.compile("="))
    if len(sides) == 2:
        left, right = (_Reader(s).whole() for s in sides)
        return ("expression", right) if left[0] == "name" else ("equation", ("-", left, right))
    return ("expression", _Reader(text).whole())


def _equal(a: tuple, b: tuple) -> bool:
    if a[0] != b[0]:
        return False
    if a[0] == "expression":
        return same_expression(a[1], b[1])
    if a[0] == "equation":
        return same_equation(a[1], b[1])
    if a[0] == "sequence":
        return a[1:3] == b[1:3] and len(a[3]) == len(b[3]) and all(map(_equal, a[3], b[3]))
    return all(any(_equal(x, y) for y in b[1]) for x in a[1]) and all(any(_equal(x, y) for x in a[1]) for y in b[1])


def symbolic_equal(a: str | None, b: str | None) -> bool:
    """Whether two stated answers mean the same; false where one cannot be read."""
    try:
        return _equal(value(a or ""), value(b or ""))
    except (ValueError, ArithmeticError, DecimalException, _Real, RecursionError):
        return False


def verified(said: str | None, right: str | None) -> bool:
    """Equal as symbols, or at the coarser number of significant figures."""
    return symbolic_equal(said, right) or significant_equal(said or "", right or "")


def answers_agree(said: str | None, right: str | None) -> bool:
    """Whether two solutions state the same answer: as numbers and normalised texts, or else verified."""
    return math_equal(said, right) or verified(locate(said), locate(right))


@F.pandas_udf(BooleanType())
def symbolic_equal_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([symbolic_equal(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


@F.pandas_udf(BooleanType())
def answers_agree_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([answers_agree(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)
