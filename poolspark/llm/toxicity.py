"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 4).

``fit`` learns from a bounded, documented sample of labelled rows (``rows``, the smallest id hashes) in
``epochs`` passes; per-coordinate rates and L1 leave a few thousand weights, which are broadcast as sorted
(index, weight) pairs, at most 2^22 of them. ``score`` adds up the weights of the distinct features of each
whole text.

Defined results: a null or empty text has the probability of the bias alone; without any labelled row every
score is 0.5; repeated rows score alike; other columns stay, ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolspark.llm import linear
from poolspark.llm import words as W

ROWS = 20_000
THRESHOLD = 0.7


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << linear.BITS, np.float32)
        out[self.index] = self.weight
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", rows: int = ROWS,
        epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0) -> Model:
    """``labels`` holds the ids that may be learnt from; a label above 0 is toxic."""

    def featurise(column):
        feature, doc = linear.distinct(*linear.text_features(column))
        return np.split(feature.astype(np.int32), np.searchsorted(doc, np.arange(1, len(column))))

    def learn(rows):
        own = linear.Ftrl((1 << linear.BITS) + 1, alpha, beta, l1, l2)
        bias = np.array([1 << linear.BITS])
        for _ in range(epochs):
            for y, raw in rows:
                at = np.concatenate([np.frombuffer(raw, np.int32), bias])
                w = own.weights(at)
                p = linear.sigmoid(w.sum())
                own.update(at, w, np.full(len(at), p - y))
        w = own.weights(np.arange((1 << linear.BITS) + 1))
        used = np.append(np.flatnonzero(w[:-1]), 1 << linear.BITS)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(w[used])], ["i", "w"])

    sample = linear.labelled_sample(docs, labels, (F.col(label) > 0), rows, text, key)
    found = sorted((r.i, r.w) for r in linear.trained(sample, featurise, learn, "i long, w double"))
    bias = next((w for i, w in found if i == 1 << linear.BITS), 0.0)
    body = [(i, w) for i, w in found if i < 1 << linear.BITS]
    return Model(np.array([i for i, _ in body], np.int32), np.array([w for _, w in body], np.float32), float(bias))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` (probability) and ``predicted`` (1 from ``threshold`` on)."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + ["score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = own.table()
        for batch in W.pieces(batches, text):
            feature, doc = linear.text_features(batch.column(text))
            hit = np.flatnonzero(table[feature])
            feature, doc = linear.distinct(feature[hit], doc[hit])
            total = own.bias + np.bincount(doc, weights=table[feature].astype(np.float64), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(linear.sigmoid(total))], [*kept, "score"])

    return docs.select(*kept).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
