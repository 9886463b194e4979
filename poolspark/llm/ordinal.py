"""Quality by ordinal cumulative-link regression over hashed text (operator 8).

Ratings are grades 0, 1, .. K - 1. All grades share one weight vector; ordered thresholds part them:

    P(grade <= k) = sigmoid(theta_k - w . x),   theta_0 < theta_1 < ...

Features: words, pairs and skip-grams as in ``linear``, and the shape of the text (shares of capitals, of
symbols, of digits and of distinct words, mean word length, length), each as one of sixteen steps. Weights are
learnt by FTRL-proximal on a bounded sample (``rows``), thresholds by their own adaptive rates; their
order is kept by learning the gaps between them in the logarithm.

``score`` gives the expected grade and, for selection, the tail probability P(grade >= ``tail``).

Defined results: a null or empty text is scored on its shape alone; without labelled rows all grades are
equally likely; repeated rows score alike; other columns stay, the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from poolspark.llm import linear
from poolspark.llm import words as W

U64 = np.uint64
ROWS = 20_000
STEPS = 16
OUTPUTS = ["expected_grade", "tail_probability"]
_CAPITAL, _DIGIT = W.byte_class(bytes(range(65, 91))), W.byte_class(bytes(range(48, 58)))
_SYMBOL = W.byte_class(bytes(c for c in range(33, 127) if not chr(c).isalnum()))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number), distinct; the shape features have indexes above those of the text."""
    n = len(column)
    feature, doc = linear.distinct(*linear.text_features(column))
    data, offsets = W.texts(column)
    size = np.maximum(np.diff(offsets), 1)
    start, end, owner = W.spans(data, offsets)
    words = np.bincount(owner, minlength=n)
    kinds = owner[np.unique(W.span_hashes(data, start, end) * U64(3) + owner.astype(U64) * U64(0x9E3779B97F4A7C15), return_index=True)[1]]
    shares = [_share(data, offsets, c, size) for c in (_CAPITAL, _SYMBOL, _DIGIT)]
    steps = [np.sqrt(s) * STEPS for s in shares]
    steps.append(np.bincount(kinds, minlength=n) / np.maximum(words, 1) * STEPS)
    steps.append(size / np.maximum(words, 1))
    steps.append(np.log2(words + 1))
    shape = np.stack([np.minimum(s, STEPS - 1).astype(np.int64) + (1 << linear.BITS) + STEPS * i for i, s in enumerate(steps)], 1)
    feature = np.concatenate([feature, shape.ravel()])
    doc = np.concatenate([doc, np.repeat(np.arange(n), shape.shape[1])])
    order = np.argsort(doc, kind="stable")
    return feature[order], doc[order]


SIZE = (1 << linear.BITS) + 6 * STEPS


def _share(data, offsets, members, size):
    total = np.concatenate([[0], np.cumsum(W.translated(data, members))])
    return (total[offsets[1:]] - total[offsets[:-1]]) / size


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    thresholds: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(SIZE, np.float32)
        out[self.index] = self.weight
        return out


def _loss(s: float, y: int, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Slopes of -log P(y) by the score and by each threshold."""
    c = linear.sigmoid(theta - s)
    upper = c[y] if y < len(theta) else 1.0
    lower = c[y - 1] if y else 0.0
    p = max(upper - lower, 1e-9)
    by_theta = np.zeros(len(theta))
    if y < len(theta):
        by_theta[y] -= c[y] * (1 - c[y]) / p
    if y:
        by_theta[y - 1] += c[y - 1] * (1 - c[y - 1]) / p
    return -by_theta.sum(), by_theta


def fit(docs: DataFrame, labels: DataFrame, grade: Column, grades: int, text: str = "text", key: str = "doc_id", rows: int = ROWS,
        epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0) -> Model:
    """``grade`` is an expression over ``labels`` with values 0 .. ``grades`` - 1."""

    def featurise(column):
        feature, doc = features(column)
        return np.split(feature.astype(np.int32), np.searchsorted(doc, np.arange(1, len(column))))

    def learn(rows):
        own = linear.Ftrl(SIZE, alpha, beta, l1, l2)
        # theta_0 and the logarithms of the gaps, started where all grades are equally likely.
        even = np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1))
        raw = np.concatenate([even[:1], np.log(np.diff(even))])
        spent = np.ones(len(raw))
        for _ in range(epochs):
            for y, blob in rows:
                at = np.frombuffer(blob, np.int32)
                theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
                w = own.weights(at)
                by_score, by_theta = _loss(w.sum(), min(max(y, 0), grades - 1), theta)
                own.update(at, w, np.full(len(at), by_score))
                g = np.cumsum(by_theta[::-1])[::-1] * np.concatenate([[1.0], np.exp(raw[1:])])
                spent += g * g
                raw -= 0.1 * g / np.sqrt(spent)
        w = own.weights(np.arange(SIZE))
        used = np.flatnonzero(w)
        theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, SIZE + np.arange(len(theta)))), pa.array(np.append(w[used], theta))], ["i", "w"])

    sample = linear.labelled_sample(docs, labels, grade, rows, text, key)
    found = sorted((r.i, r.w) for r in linear.trained(sample, featurise, learn, "i long, w double"))
    body = [(i, w) for i, w in found if i < SIZE]
    theta = [w for i, w in found if i >= SIZE] or np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1))
    return Model(np.array([i for i, _ in body], np.int32), np.array([w for _, w in body], np.float32), np.array(theta, np.float64))


def score(docs: DataFrame, model: Model, tail: int = 1, text: str = "text") -> DataFrame:
    """Adds ``expected_grade`` and ``tail_probability`` = P(grade >= ``tail``)."""
    kept = [c for c in docs.columns if c not in OUTPUTS]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
                       + ["expected_grade double", "tail_probability double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = own.table()
        for batch in W.pieces(batches, text):
            feature, doc = features(batch.column(text))
            s = np.bincount(doc, weights=table[feature].astype(np.float64), minlength=batch.num_rows)
            above = 1.0 - linear.sigmoid(own.thresholds[None, :] - s[:, None])  # P(grade > k)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(above.sum(1)), pa.array(above[:, tail - 1].copy())],
                                             [*kept, *OUTPUTS])

    return docs.select(*kept).mapInArrow(run, schema)
