"""Language identification by a convolutional network over bytes, trained and applied with numpy.

A text's UTF-8 bytes (Latin letters in lower case) are cut into windows of `WINDOW` bytes, the last one padded. Filters of
several widths run over the byte embeddings of each window, max pooling keeps the best place of each filter, and a softmax
layer gives the window's log-probabilities; windows, weighted by their bytes, add up to the text's.

For inference embedding and filters are folded into tables over bytes and pairs of bytes, so that a filter of up to four
bytes costs two look-ups a place. The model learns from at most `sample_rows` labelled rows (a documented bound); every
window of every whole text is read, a bounded batch of windows at a time.

Defined results: a null text, or one without a letter, is `und` with score 0; without labelled rows everything is `und`;
with one label that label gets score 1; repeated rows and ties (first label in order) are treated alike; other columns are
carried along (those with the names of results give way).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import chunks, is_remainder, labelled_sample, raw

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with Latin letters in lower case: ASCII, and the two-byte capitals after 0xC3."""
    out = _LOWER[data]
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E)
        out[1:][capital] += 0x20
    return out


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, WINDOW) bytes, padded with 0, the number of the text of each window, and its own bytes."""
    length = np.diff(offsets)
    n = -(-length // WINDOW)
    text = np.repeat(np.arange(len(length)), n)
    first = np.cumsum(n) - n
    out = np.zeros(n.sum() * WINDOW, np.uint8)
    out[np.arange(len(data)) + np.repeat(first * WINDOW - offsets[:-1], length)] = data
    return out.reshape(-1, WINDOW), text, np.minimum(WINDOW, length[text] - (np.arange(len(text)) - first[text]) * WINDOW)


@dataclass
class Model:
    labels: list[str]
    embed: np.ndarray | None = None
    filters: list[np.ndarray] | None = None
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None

    def tables(self):
        """For each width the look-ups: (table over pairs or bytes, offset of its first byte)."""
        found = []
        for k, w in zip(WIDTHS, self.filters, strict=True):
            single = [(self.embed @ w[j]).astype(np.float32) for j in range(k)]
            pairs = [((single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1), j, True) for j in range(0, k - 1, 2)]
            found.append(pairs + ([(single[-1], k - 1, False)] if k % 2 else []))
        return found

    def log_probabilities(self, x: np.ndarray, tables) -> np.ndarray:
        """Of each window (n, WINDOW), for each label."""
        code = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        pooled = []
        for k, parts in zip(WIDTHS, tables, strict=True):
            places = WINDOW - k + 1
            total = None
            for table, j, pair in parts:
                got = np.take(table, (code if pair else x)[:, j : j + places].astype(np.intp), axis=0)
                total = got if total is None else np.add(total, got, out=total)
            pooled.append(total.max(1))
        h = np.maximum(np.hstack(pooled) + self.bias, 0) @ self.out + self.out_bias
        h -= h.max(1, keepdims=True)
        return h - np.log(np.exp(h).sum(1, keepdims=True))

    def predict(self, column: pa.Array, tables) -> tuple[list[str], np.ndarray]:
        data, offsets = raw(column)
        n = len(column)
        data = lower(data)
        if not len(self.labels):
            return [UNKNOWN] * n, np.zeros(n)
        letter = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
        has = letter[offsets[1:]] > letter[offsets[:-1]]
        for k in np.flatnonzero(~has & (np.diff(offsets) > 0)):
            has[k] = any(c.isalpha() for c in column[int(k)].as_py() or "")
        total = np.zeros((n, len(self.labels)))
        if self.embed is not None:
            x, text, size = windows(data, offsets)
            for at in range(0, len(x), 256):
                p = self.log_probabilities(x[at : at + 256], tables) * (size[at : at + 256] / WINDOW)[:, None]
                for label in range(len(self.labels)):
                    total[:, label] += np.bincount(text[at : at + 256], p[:, label], n)
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.labels[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)], np.where(has, score, 0.0)


def train(texts, labels, per_text: int = 4, epochs: int = 10, batch: int = 128, rate: float = 0.005, seed: int = 1) -> Model:
    """Fit the network by Adam; up to per_text windows of each text, from all its places, some of them cut short."""
    kinds = sorted(set(labels))
    if len(kinds) < 2:
        return Model(kinds)
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text, label in zip(texts, labels, strict=True):
        data = lower(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
        if not len(data):
            continue
        for start in rng.integers(0, max(1, len(data) - WINDOW // 2), min(per_text, 1 + len(data) // WINDOW)):
            size = WINDOW if rng.random() < 0.7 else int(rng.integers(8, WINDOW))
            x = np.zeros(WINDOW, np.uint8)
            part = data[start : start + size]
            x[: len(part)] = part
            xs.append(x)
            ys.append(kinds.index(label))
    x, y = np.array(xs), np.array(ys)
    hidden = FILTERS * len(WIDTHS)
    value = {"embed": rng.normal(0, 0.5, (256, EMBED)), "bias": np.zeros(hidden), "out": rng.normal(0, 0.2, (hidden, len(kinds))), "out_bias": np.zeros(len(kinds))}
    value |= {f"w{k}": rng.normal(0, 0.5 / np.sqrt(k * EMBED), (k, EMBED, FILTERS)) for k in WIDTHS}
    moment = {n: [np.zeros_like(v), np.zeros_like(v)] for n, v in value.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            bx, by = x[order[at : at + batch]], y[order[at : at + batch]]
            rows = np.arange(len(bx))
            e = value["embed"].astype(np.float32)[bx]
            pooled, places = [], []
            for k in WIDTHS:
                n = WINDOW - k + 1
                conv = sum(e[:, j : j + n] @ value[f"w{k}"][j].astype(np.float32) for j in range(k))
                place = conv.argmax(1)
                places.append(place)
                pooled.append(np.take_along_axis(conv, place[:, None, :], 1)[:, 0])
            pre = np.hstack(pooled) + value["bias"]
            h = np.maximum(pre, 0)
            z = h @ value["out"] + value["out_bias"]
            z = np.exp(z - z.max(1, keepdims=True))
            p = z / z.sum(1, keepdims=True)
            p[rows, by] -= 1
            p /= len(bx)
            grad = {"out": h.T @ p, "out_bias": p.sum(0)}
            dh = (p @ value["out"].T) * (pre > 0)
            grad["bias"] = dh.sum(0)
            grad["embed"] = np.zeros_like(value["embed"])
            for i, k in enumerate(WIDTHS):
                g = dh[:, i * FILTERS : (i + 1) * FILTERS]
                grad[f"w{k}"] = np.zeros_like(value[f"w{k}"])
                for j in range(k):
                    byte = np.take_along_axis(bx, places[i] + j, 1)
                    grad[f"w{k}"][j] = np.einsum("bf,bfe->ef", g, value["embed"][byte])
                    np.add.at(grad["embed"], byte.ravel(), (g[:, :, None] * value[f"w{k}"][j].T[None]).reshape(-1, EMBED))
            step += 1
            for n, v in value.items():
                m = moment[n]
                m[0] = 0.9 * m[0] + 0.1 * grad[n]
                m[1] = 0.999 * m[1] + 0.001 * grad[n] ** 2
                v -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Model(kinds, value["embed"], [value[f"w{k}"] for k in WIDTHS], value["bias"].astype(np.float32), value["out"].astype(np.float32), value["out_bias"].astype(np.float32))


def identify(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add lang_pred and score to every row."""
    kept = [f for f in docs.schema.fields if (keep_text or f.name != text) and f.name not in ("lang_pred", "score")]
    schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        tables = model.tables() if model.embed is not None else None
        for batch in batches:
            for part in chunks(batch, text, 1_000_000):
                lang, score = model.predict(part.column(text), tables)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*(f.name for f in kept), "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


SAMPLE_ROWS = 5000
PARTS, HELD = 4, 2


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    return train(*labelled_sample(docs, None, "lang", sample_rows, PARTS, HELD))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs)
    return identify(docs.select("doc_id", "text"), model, keep_text=False).select("doc_id", is_remainder("doc_id", PARTS, HELD).alias("held_out"), "lang_pred", "score")
