"""Quality classifier by a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from its own features and those of its neighbours; forward-backward gives the
marginal of each line, and the marginals, weighted by the lines' lengths, add up to the document's quality, which a
logistic curve fitted on the labelled sample turns into a score.

In training every line of a document has the document's label. The model learns from at most `sample_rows` labelled rows
(a documented bound); scoring reads every line of every whole text, a batch of lines at a time with numpy.

Defined results: null and empty texts have no line and get the share of label 1 in the sample; lines without a word are
skipped; without labels of both kinds every score is 0.5; repeated rows and ties are scored alike; other columns are
carried along (those with the names of results give way).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from .common import Words, chunks, grams, is_remainder, labelled_sample, logistic

NAMES = ("words", "symbols", "pipes", "bangs", "upper", "digits", "word_size", "again", "copy", "stop", "letters")
_CLASS = {
    "symbols": b"#*$%&|<>~^={}[]\\@_+",
    "pipes": b"|",
    "bangs": b"!?",
    "upper": bytes(range(65, 91)),
    "digits": bytes(range(48, 58)),
    "letters": bytes(range(97, 123)) + bytes(range(65, 91)) + bytes(range(128, 256)),
}
_TABLE = {}
for _name, _bytes in _CLASS.items():
    _TABLE[_name] = np.zeros(256, np.uint8)
    _TABLE[_name][list(_bytes)] = 1


@dataclass
class Lines:
    """Lines with a word, of all texts in turn: features, words, and how many each text has."""

    own: np.ndarray
    size: np.ndarray
    count: np.ndarray


def line_features(column: pa.Array) -> Lines:
    words = Words(column)
    data, offsets = words.data, words.offsets
    if not len(words.start):
        return Lines(np.zeros((0, len(NAMES))), np.zeros(0), np.zeros(len(column), np.int64))
    # a line begins at a text's first word, and at a word with a line break before it
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line_no = breaks[words.start]
    text_no = words.text_of()
    new = np.ones(len(line_no), bool)
    new[1:] = (np.diff(line_no) > 0) | (np.diff(text_no) > 0)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(line_no)) - 1
    start, end = words.start[head], words.end[last]
    n_words = (last - head + 1).astype(float)
    size = (end - start).astype(float)

    def share(name: str) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(_TABLE[name][data], dtype=np.int64)])
        return (total[end] - total[start]).astype(float)

    letters = share("letters")
    # words whose run of three words has come before in the text
    run = grams(words.hash, 3) ^ (text_no.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(run, kind="stable")
    seen = np.zeros(len(run), bool)
    seen[order[1:]] = run[order[1:]] == run[order[:-1]]
    seen &= words.whole(3)
    again = np.add.reduceat(seen, head) / n_words
    # lines equal to an earlier one of the text, by the sum of mixed word hashes
    key = np.add.reduceat(words.hash * (2 * (np.arange(len(words.hash)) - np.repeat(head, last - head + 1)).astype(np.uint64) + np.uint64(1)), head) ^ text_no[head].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    copy = np.zeros(len(head))
    copy[order[1:]] = key[order[1:]] == key[order[:-1]]
    own = np.column_stack([np.log1p(n_words), share("symbols") / size, share("pipes") / n_words, share("bangs") / n_words, share("upper") / np.maximum(letters, 1), share("digits") / size, np.log(size / n_words), again, copy, data[end - 1] == 46, letters / size]).astype(float)
    return Lines(own, n_words, np.bincount(text_no[head], minlength=len(column)))


def with_neighbours(lines: Lines) -> np.ndarray:
    """Own features, then those of the line before and after (zero at the ends of a text)."""
    own, n = lines.own, len(lines.own)
    ends = np.cumsum(lines.count)
    starts = (ends - lines.count)[lines.count > 0]
    before, after = np.zeros_like(own), np.zeros_like(own)
    if n:
        before[1:], after[:-1] = own[:-1], own[1:]
        before[starts] = 0
        after[ends[lines.count > 0] - 1] = 0
    return np.hstack([own, before, after])


@dataclass
class Model:
    weights: np.ndarray | None = None
    moves: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    curve: np.ndarray | None = None
    prior: float = 0.5

    def marginals(self, lines: Lines) -> np.ndarray:
        """Of each line, the probability that it is good."""
        x = (with_neighbours(lines) - self.centre) / self.scale
        return forward_backward(np.hstack([x, np.ones((len(x), 1))]) @ self.weights, self.moves, lines.count)[0]

    def quality(self, lines: Lines, good: np.ndarray) -> np.ndarray:
        """Features of each text that the curve takes: the weighted mean of the marginals, as log-odds, and the length."""
        text = np.repeat(np.arange(len(lines.count)), lines.count)
        total = np.bincount(text, lines.size, len(lines.count))
        mean = np.bincount(text, lines.size * good, len(lines.count)) / np.maximum(total, 1)
        return np.column_stack([np.log((mean + 1e-3) / (1 - mean + 1e-3)), np.log1p(total)])

    def scores(self, column: pa.Array) -> tuple[np.ndarray, Lines, np.ndarray]:
        lines = line_features(column)
        if self.weights is None:
            return np.full(len(column), self.prior), lines, np.full(len(lines.own), self.prior)
        good = self.marginals(lines)
        q = self.quality(lines, good)
        z = np.column_stack([q, np.ones(len(q))]) @ self.curve
        return np.where(lines.count > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), self.prior), lines, good


def forward_backward(emission: np.ndarray, moves: np.ndarray, count: np.ndarray):
    """Marginals of label 1, expected moves (2 x 2, summed) and log-likelihood terms for chains laid end to end.

    Label 1 has the score `emission`, label 0 has 0. All chains advance together, a place at a time; longer ones go first,
    so that those still running are a prefix.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    chains = np.flatnonzero(count)
    order = chains[np.argsort(-count[chains], kind="stable")]
    first = (np.cumsum(count) - count)[order]
    length = count[order]
    running = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    unary = np.stack([np.zeros(n), emission], 1)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[first] = unary[first]
    for k in range(1, length[0]):
        at = first[: running[k]] + k
        prev = forward[at - 1]
        forward[at] = unary[at] + np.stack([np.logaddexp(prev[:, 0] + moves[0, j], prev[:, 1] + moves[1, j]) for j in (0, 1)], 1)
    for k in range(length[0] - 1, 0, -1):
        at = first[: running[k]] + k
        nxt = backward[at] + unary[at]
        backward[at - 1] = np.stack([np.logaddexp(moves[i, 0] + nxt[:, 0], moves[i, 1] + nxt[:, 1]) for i in (0, 1)], 1)
    both = forward + backward
    norm = np.logaddexp(both[:, 0], both[:, 1])
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    expected = np.array([[np.exp(np.minimum(0, forward[at - 1, i] + moves[i, j] + unary[at, j] + backward[at, j] - norm[at])).sum() for j in (0, 1)] for i in (0, 1)])
    return np.exp(both[:, 1] - norm), expected, float(norm[first].sum())


def train(texts, labels, rounds: int = 150, step: float = 0.1, ridge: float = 1e-3) -> Model:
    """Fit weights and moves by Adam on the conditional likelihood (mean over lines), then the document curve."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return Model()
    whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    parts = [line_features(c.column(0)) for c in chunks(whole, "text")]
    lines = Lines(np.concatenate([p.own for p in parts]), np.concatenate([p.size for p in parts]), np.concatenate([p.count for p in parts]))
    x = with_neighbours(lines)
    model = Model(prior=float(labels.mean()))
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-6
    x = np.hstack([(x - model.centre) / model.scale, np.ones((len(x), 1))])
    y = np.repeat(labels, lines.count)
    pair = np.zeros((2, 2))
    for label in (0, 1):
        pair[label, label] = np.maximum(lines.count[labels == label] - 1, 0).sum()
    value = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(value), np.zeros_like(value)
    for t in range(1, rounds + 1):
        good, expected, _ = forward_backward(x @ value[:-4], value[-4:].reshape(2, 2), lines.count)
        gradient = np.concatenate([x.T @ (y - good), (pair - expected).ravel()]) / len(x) - ridge * value
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        value += step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights, model.moves = value[:-4], value[-4:].reshape(2, 2)
    q = model.quality(lines, model.marginals(lines))
    some = lines.count > 0
    model.curve = logistic(q[some], labels[some])
    return model


def score_documents(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """Add score, predicted and line_good (the marginal of each line with a word) to every row."""
    kept = [f for f in docs.schema.fields if (keep_text or f.name != text) and f.name not in ("score", "predicted", "line_good")]
    schema = StructType([*kept, StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("line_good", ArrayType(FloatType()))])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                scores, lines, good = model.scores(part.column(text))
                ends = np.concatenate([[0], np.cumsum(lines.count)]).astype(np.int32)
                marginals = pa.ListArray.from_arrays(pa.array(ends), pa.array(good.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), marginals], [*(f.name for f in kept), "score", "predicted", "line_good"])

    return docs.mapInArrow(run, schema)


SAMPLE_ROWS = 4000
PARTS, HELD = 3, 1


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    return train(*labelled_sample(docs, labels, "quality", sample_rows, PARTS, HELD))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model, keep_text=False).select("doc_id", is_remainder("doc_id", PARTS, HELD).alias("held_out"), "score", "predicted")
