"""Small made-up texts, and a table with every odd case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block string, found int, kept string, `key` int, n int"


def sentence(rng: random.Random, n: int, stem: str = "") -> str:
    return " ".join(f"{stem}w{rng.randrange(5000)}" for _ in range(n))


def rows(texts, lang="en", source="s", first=0):
    return [(first + k, t, lang, source, None if t is None else len(t), 0.5, "b", 1, "k", 2, 3) for k, t in enumerate(texts)]


def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, copies, repeated rows, clashing names."""
    rng = random.Random(5)
    long_text = sentence(rng, 60_000)
    copy = sentence(rng, 80)
    found = rows(["", " \n\t ", None, "x", copy, copy, long_text, "one two three", "Ünï ñ çödé 漢字 😀 " * 12, "!!! ... ---", "a\x0bb\x0cc\r\nd"])
    found += [found[4], found[4], (None,) * 11, (None, copy, None, None, None, None, None, None, None, None, None), (3, None, None, "s", 0, None, None, None, None, None, None)]
    return spark.createDataFrame(found, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
