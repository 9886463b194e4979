"""Hashed text features and FTRL-proximal weights, shared by the linear scorers (operators 4 and 8).

Features of a text are the distinct hashes of its words, pairs of neighbours, pairs with one word
between them (skip-grams) and the heads of words (4 to 8 bytes: inflected forms of one stem); they count
once each, whatever the length of the text. Words are runs of letters and digits, A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolspark.llm import words as W

U64 = np.uint64
BITS = 22  # 4 M weights at most: 32 MB as (index, weight) pairs, the bound of what is broadcast
HEADS = (4, 5, 6, 7, 8)
_SALT = {n: U64(0x50 + n) for n in range(1, 20)}


def text_features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number) of every word, pair, skip-gram and head, with repeats."""
    data, offsets = W.texts(column)
    low = W.translated(data, W.LOWER)
    start, end, doc = W.spans(low, offsets, W.PUNCTUATION)
    h = W.span_hashes(low, start, end)
    found, owner = [W.mix(h ^ _SALT[1])], [doc]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        found.append(W.mix(h[:-gap][same] * U64(3) + h[gap:][same] * U64(7) + _SALT[gap + 1]))
        owner.append(doc[gap:][same])
    for size in HEADS:
        long = end - start > size
        found.append(W.mix(W.span_hashes(low, start[long], start[long] + size) ^ _SALT[size + 4]))
        owner.append(doc[long])
    return (np.concatenate(found) >> U64(64 - bits)).astype(np.int64), np.concatenate(owner)


def distinct(feature: np.ndarray, doc: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((doc.astype(np.int64) << bits) | feature)
    return both & ((1 << bits) - 1), both >> bits


class Ftrl:
    """FTRL-proximal: per-coordinate rates, L1 sets weights without steady evidence to exactly 0."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / rate, 0.0)

    def update(self, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, rows: int, text: str, key: str) -> DataFrame:
    """(o, y, t): at most ``rows`` labelled rows, those with the smallest hash of the id, with their texts.

    The sample is what is broadcast: ``rows`` pairs of numbers. Rows without id, label or text are not learnt from.
    """
    chosen = (labels.select(F.col(key).cast("long").alias("k"), label.cast("int").alias("y")).where("k is not null and y is not null")
              .withColumn("o", F.xxhash64("k")).orderBy("o", "k", "y").limit(rows))
    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    return texts.join(F.broadcast(chosen), "k").select("o", "k", "y", "t")


def trained(sample: DataFrame, featurise, learn, schema: str) -> list:
    """Features are made where the texts are; the bounded sample is then learnt from in one task, in order of hash.

    ``featurise(batch)`` gives one array of features per row, ``learn(list of (y, features))`` the rows to return.
    """

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "t"):
            rows = [np.asarray(x).tobytes() for x in featurise(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("k"), batch.column("y"), pa.array(rows, pa.binary())], ["o", "k", "y", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += [(y, f) for y, f in zip(batch.column("y").to_pylist(), batch.column("f").to_pylist())]
        yield from learn(rows)

    ready = sample.mapInArrow(prepare, "o long, k long, y int, f binary").repartition(1).sortWithinPartitions("o", "k", "y", "f")
    return ready.mapInArrow(run, schema).collect()


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))
