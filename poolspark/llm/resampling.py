"""Importance resampling towards a target: hashed n-gram counts, gains per bucket, Gumbel draws.

Words are lower-cased (A-Z only); features are all runs of 1 to ``longest`` words joined by one space, and the CRC-32 of
a feature names its bucket. A bucket's gain is the scaled log ratio of its share in the target to its share in the rows;
a row's weight is the floored mean gain of its features. A row's score is its weight plus Gumbel noise hashed from its
id, so the rows with the highest scores are a sample without replacement by weight.

Counts are added per bucket, a table of fixed length. The ranks of the drawn rows come from a histogram of scores, which
names the lowest score that can be drawn, and from a range sort of the rows from there on: position in the range plus
the rows of the ranges before it. No window holds more than one range.

Defined cases: a null text has no words, no features and weight 0; a null id is hashed as empty and ranks after all ids;
rows of equal score and id rank by weight, features and a hash of the text; an empty table gives no rows. Only the named columns of
``docs`` are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolspark.llm.crc import span_crcs
from poolspark.llm.store import shared_folder
from poolspark.llm.words import LOWER, byte_class, pieces, spans, texts, translated

BUCKETS = 10_000
SCALE = 1000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
_BATCH = 1 << 20  # bytes of text worked on at once
# Everything in ASCII that is neither a digit nor a letter; bytes from 0x80 on belong to words.
GAP = byte_class(bytes(c for c in range(128) if not (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A)))


def features(column: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, bucket of every feature, its text number)."""
    data, offsets = texts(column)
    start, end, doc = spans(data, offsets, GAP)
    n_words = np.bincount(doc, minlength=len(column)).astype(np.int64)
    if not len(start):
        return n_words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = translated(data, LOWER)
    if longest > 1:  # words next to each other, one space between, so that a run of words is one span
        size = end - start
        stop = np.cumsum(size + 1) - 1
        at = np.arange(int(stop[-1]) + 1, dtype=np.int64) + np.repeat(start - (stop - size), size + 1)
        data = data[np.minimum(at, len(data) - 1)]
        data[stop] = 0x20
        start, end = stop - size, stop
    values, owners = [], []
    for n in range(1, longest + 1):
        if len(start) < n:
            break
        same = doc[n - 1:] == doc[:len(doc) - n + 1]
        values.append(span_crcs(data, start[:len(start) - n + 1][same], end[n - 1:][same]))
        owners.append(doc[n - 1:][same])
    return n_words, (np.concatenate(values) % np.uint32(buckets)).astype(np.int64), np.concatenate(owners)


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(``bucket``, ``n``): features per bucket over whole texts. A task adds up its own rows before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in pieces(batches, "text", _BATCH):
            total += np.bincount(features(batch.column("text"), longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket; ``buckets`` numbers reach the driver, whatever the size of the tables."""
    counts = []
    for table in (docs, target):
        own = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(table, longest, buckets).collect():
            own[bucket] = n
        counts.append(own)
    s, t = counts
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(SCALE * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(``doc_id``, ``n_words``, ``n_features``, ``weight``, ``tie``) of every row."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", _BATCH):
            n = batch.num_rows
            n_words, bucket, owner = features(batch.column("text"), longest, buckets)
            n_features = np.bincount(owner, minlength=n).astype(np.int64)
            total = np.zeros(n, np.int64)
            some = np.flatnonzero(n_features)
            if len(some):
                # Features stand by length of run, then by text: sums per text, one length after the other.
                order = np.argsort(owner, kind="stable") if longest > 1 else slice(None)
                heads = np.concatenate([[0], np.cumsum(n_features[some])[:-1]])
                total[some] = np.add.reduceat(gains[bucket[order]], heads)
            weight = np.floor_divide(total, np.maximum(n_features, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_features), pa.array(weight), batch.column("tie")],
                ["doc_id", "n_words", "n_features", "weight", "tie"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long, tie long")


def gumbel(seed: int, doc_id: str = "doc_id", scale: int = SCALE):
    """Floored, scaled Gumbel noise from the hash of an id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(scale)) * F.log(-F.log(uniform))).cast("long")


def draw(scored: DataFrame, wanted: int, folder: str) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the ``wanted`` eligible rows of highest score, null for all others."""
    spark = scored.sparkSession
    none = F.lit(None).cast("long")
    if wanted < 1:
        return scored.withColumn("rank", none)
    # Scores are whole numbers of bounded size, so their histogram has a bounded number of rows.
    histogram = scored.where("eligible").groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lowest = histogram.withColumn("above", above).where(F.col("above") >= wanted).agg(F.max("score")).first()[0]
    near = F.col("eligible") & (F.col("score") >= lowest)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features"), F.col("tie")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = scored.where(near).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done + 1, done + n + 1, dtype=np.int64))],
                [*batch.schema.names, "part", "place"])
            done += n

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema)
    ranges.mapInArrow(number, f"{fields}, part int, place long").write.parquet(f"file://{folder}/ranges")
    placed = spark.read.parquet(f"file://{folder}/ranges")
    # One row per range reaches the driver.
    sizes = dict(placed.groupBy("part").agg(F.max("place")).collect())
    before = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)])]).tolist()
    offset = F.element_at(F.array(*[F.lit(int(x)) for x in before]), F.col("part") + 1)
    rank = (F.col("place") + offset).cast("long")
    drawn = placed.withColumn("rank", F.when(rank <= wanted, rank)).drop("part", "place")
    return drawn.unionByName(scored.where(~F.coalesce(near, F.lit(False))).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
             percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(``doc_id``, ``n_features``, ``weight``, ``score``, ``rank``) of every row of ``docs`` (``doc_id``, ``text``).

    ``target`` has the texts to come close to. Of the rows with ``least_words`` words, ``percent`` in a hundred are drawn.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "resample")
    gains = bucket_gains(docs, target, longest, buckets)
    scored = weighted(docs, gains, longest).withColumn("score", F.col("weight") + gumbel(seed)).withColumn("eligible", F.col("n_words") >= least_words)
    scored.drop("n_words").write.parquet(f"file://{folder}/scored")
    scored = spark.read.parquet(f"file://{folder}/scored")
    wanted = percent * scored.where("eligible").count() // 100
    return draw(scored, wanted, folder).select("doc_id", "n_features", "weight", "score", "rank")
