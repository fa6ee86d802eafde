"""Toxicity by maximum-scoring segments.

Every token has a log-odds of toxic against other text under informative Dirichlet priors, reduced by two standard
errors and by a drift that makes the expected score of other text negative. A linear-time scan finds all maximal-scoring
segments of a document; by extreme-value (Karlin-Altschul) statistics, with lambda solved from the null token scores, each
gets an expected number of such segments in a document of this length, and those below `significance` are passages. The
evidence of the passages is turned into a probability by a logistic curve fitted on the labelled sample.

A labelled text of whose token triples over `most_known` came in an earlier one is not counted, so near copies count once; a token counts once a text. The model learns from at most `sample_rows`
labelled rows (a documented bound); scoring reads every whole text.

Defined results: null and empty texts, or texts without a token, have no passage and the score of a text without
evidence; without labels of both kinds every score is 0; repeated rows and ties are scored alike; other columns are
carried along (those with the names of results give way).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import chunks, is_remainder, labelled_sample, logistic

TOKEN = re.compile(r"\w+")
#: A token is seen as itself and as its beginnings of these lengths (written with a hyphen), so that inflected and compound forms count.
BEGINNINGS = range(3, 8)
#: Token scores that a process remembers before it starts anew.
MOST_REMEMBERED = 500_000


def units(token: str) -> list[str]:
    return [token, *(token[:n] + "-" for n in BEGINNINGS if n < len(token))]
PASSAGES = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("evidence", DoubleType())]))


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 1.0
    rate: float = 1.0
    factor: float = 1.0
    significance: float = 0.1
    weights: tuple[float, ...] = ()
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def gain(self, token: str) -> float:
        """The greatest score of the token's units; 0 if none has one."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= MOST_REMEMBERED:
                self.known.clear()
            found = self.known[token] = max((self.scores.get(u, 0.0) for u in units(token)), default=0.0)
        return found

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Tokens of the text, and start, end (exclusive, in tokens) and evidence -ln E of each significant segment."""
        tokens = TOKEN.findall(text.lower()) if text else []
        gains = [self.gain(t) for t in tokens]
        at = [k for k, g in enumerate(gains) if g > 0]
        if not at:
            return len(tokens), []
        found = []
        for start, end, score in maximal_segments(at, [gains[k] for k in at], self.drift):
            evidence = self.rate * score - math.log(self.factor * len(tokens))
            if evidence > -math.log(self.significance):
                found.append((start, end, evidence))
        return len(tokens), found

    def features(self, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        if not found:
            return 0.0, 0.0
        return min(max(e for *_, e in found), 30.0), math.log1p(len(found))

    def score(self, found) -> float:
        if not self.weights:
            return 0.0
        a, b = self.features(found)
        z = self.weights[0] * a + self.weights[1] * b + self.weights[2]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def maximal_segments(at: list[int], gains: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, in linear time; tokens not in `at` cost `drift` each.

    Each candidate keeps the cumulative sum before it and at its end. A new token looks back for the nearest candidate
    that begins lower; if that one ends lower as well they merge, and the merged segment looks back again.
    """
    open_: list[tuple[float, float, int, int]] = []  # sum before, sum at the end, start, end
    total, last = 0.0, -1
    for k, gain in zip(at, gains, strict=True):
        total -= drift * (k - last - 1)
        low, total, last = total, total + gain, k
        high, start = total, k
        place = len(open_) - 1
        while place >= 0:
            while place >= 0 and open_[place][0] >= low:
                place -= 1
            if place < 0 or open_[place][1] >= high:
                break
            low, start = open_[place][0], open_[place][2]
            del open_[place:]
            place -= 1
        open_.append((low, high, start, k))
    return [(start, end + 1, high - low) for low, high, start, end in open_]


def _rate(chance: float, gain: float, drift: float) -> float:
    """The positive root of chance * exp(x gain) + (1 - chance) * exp(-x drift) = 1, by bisection."""
    f = lambda x: chance * math.exp(min(700, x * gain)) + (1 - chance) * math.exp(-x * drift) - 1
    low, high = 0.0, 1.0
    while f(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return max(high, 1e-6)


def train(texts, labels, prior: float = 0.05, most_tokens: int = 20_000, drift: float = 0.1, significance: float = 0.1, least_odds: float = 1.5, most_known: float = 0.3, least_texts: int = 3) -> Model:
    """Fit the model to labelled texts; the prior has so many times the tokens of the sample, most_tokens bounds its size (those of greatest confidence stay);
    tokens count for toxic text only if the reduced log-odds are over least_odds."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return Model()
    texts = list(texts)
    fresh, seen = [], set()
    for text in texts:
        tokens = TOKEN.findall(text.lower())
        triples = {h for h in (zlib.crc32("\n".join(t).encode()) for t in zip(["", *tokens[:-1]], tokens, [*tokens[1:], ""], strict=True)) if h % 8 == 0}
        fresh.append(len(triples & seen) <= most_known * len(triples))
        seen |= triples
    del seen
    counts, n = (Counter(), Counter()), [0, 0]
    for side in (1, 0):
        for text, label, new in zip(texts, labels, fresh, strict=True):
            if new and int(label) == side:
                found = {u for t in set(TOKEN.findall(text.lower())) for u in units(t)}
                n[side] += len(found)
                counts[side].update(found if side else found & counts[1].keys())
        if side:
            counts = (counts[0], Counter({u: c for u, c in counts[1].items() if c >= least_texts}))
    total = sum(n) or 1
    mass = prior * total
    scores = {}
    for token in counts[1]:
        toxic, other = counts[1][token], counts[0][token]
        alpha = mass * (toxic + other) / total
        odds = math.log((toxic + alpha) / (n[1] + mass - toxic - alpha)) - math.log((other + alpha) / (n[0] + mass - other - alpha))
        low = odds - 2 * math.sqrt(1 / (toxic + alpha) + 1 / (other + alpha))
        if low > least_odds:
            scores[token] = low
    if not scores:
        return Model()
    kept = sorted(scores, key=lambda t: (-scores[t], t))[:most_tokens]
    model = Model({t: scores[t] for t in kept}, significance=significance)
    gains = [model.gain(t) for text, label in zip(texts, labels, strict=True) if not label for t in TOKEN.findall(text.lower())]
    hits = [g for g in gains if g > 0] or [max(scores.values())]
    null, mean = (len(hits) + 0.5) / (len(gains) + 1), sum(hits) / len(hits)
    model.drift = max(drift, 1.5 * null * mean / (1 - null))
    model.rate, model.factor = _rate(null, mean, model.drift), null
    x = np.array([model.features(model.passages(t)[1]) for t in texts])
    model.weights = tuple(logistic(x, labels))
    return model


def score_documents(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, keep_text: bool = True) -> DataFrame:
    """Add score, predicted and passages (start, end, evidence; in tokens) to every row; the text stays if keep_text."""
    kept = [f for f in docs.schema.fields if (keep_text or f.name != text) and f.name not in ("score", "predicted", "passages")]
    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("passages", PASSAGES)]
    schema = StructType([*kept, *fields])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                found = [model.passages(t)[1] for t in part.column(text).to_pylist()]
                scores = [model.score(x) for x in found]
                passages = pa.array([[{"start": a, "end": b, "evidence": e} for a, b, e in x] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())])))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), passages], [*(f.name for f in kept), "score", "predicted", "passages"])

    return docs.mapInArrow(run, schema)


SAMPLE_ROWS = 8000
PARTS, HELD = 4, 2


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    return train(*labelled_sample(docs, labels, "toxic", sample_rows, PARTS, HELD))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model, keep_text=False).select("doc_id", is_remainder("doc_id", PARTS, HELD).alias("held_out"), "score", "predicted")
