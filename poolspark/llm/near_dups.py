"""Near-duplicates by ProbMinHash, banding and verification (operator 9).

A text is its distinct runs of five words (all its words, if fewer), weighted by 1 + ln(count). Every
element sends points on a Poisson process whose rate is its weight; a point falls into a random register,
and a register keeps the element of its earliest point. Two texts agree in a register with the probability
Jaccard of their weighted sets. Points later than the time by which all registers are full cannot matter, so
long texts stop after one point per element, and a text whose registers are not yet full goes on.

125 registers in 25 bands of 5: a pair at 0.8 shares a band with probability 0.99995. Links are judged by the plain sets, and
where one text repeats an element more often than the other, the weighted sets can be far less alike than those. So every text
has the bands of its plain set (all weights 1) too; they differ only in texts that repeat an element. Texts that are equal
word for word are one node from the start, so copies make neither bands nor pairs.

Every text also leaves a parity sketch: 512 bits, each set if an odd number of its elements fall on it. Two sketches
differ in at most as many bits as the sets differ in elements, and a similarity bounds that number by the sizes. So the join
of a bucket drops pairs that cannot be alike before any set is read, and loses none that is.

Within a band bucket not all pairs are made. Members are compared with a leader; links are verified
by the exact Jaccard similarity of the sets; classes are the connected components of the links. While a bucket
still holds members of different classes, it gets sixteen times as many new leaders (members with most links first,
for they are the middle of a family) and only pairs across classes are compared, until every bucket is of
one class or all its members have led: then all pairs that could still join two classes have been compared.

Defined results: a text without words, or a row without id, is its own class; repeated rows share a class; a
class is named by its smallest id; an empty table gives no rows. Only id and text are read, other columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolspark.llm import store
from poolspark.llm import words as W
from poolspark.llm.store import fresh, shared_folder

U64 = np.uint64
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
LEADERS = 1
GROWTH = 16
_FAR = 4.0
_TEXTS = 256
_PIECE = 1 << 20  # bytes of text worked on at once: a task's arrays take some thirty times as much
PARITY = 8  # words of 64 bits that a set leaves as its parity sketch
ODD = [f"odd{i}" for i in range(PARITY)]


def shingles(batch_text: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, text number, hash of the word sequence of each text): elements of one text may repeat."""
    data, offsets = W.texts(batch_text)
    data = W.translated(data, W.LOWER)
    start, end, doc = W.spans(data, offsets)
    h = W.span_hashes(data, start, end)
    n = np.bincount(doc, minlength=len(batch_text))
    first = np.cumsum(n) - n
    runs = W.run_hashes(h, size)
    inside = W.within(doc, size)
    # The sequence as a whole: each word hash bound to its place, added up.
    place = np.arange(len(h)) - np.repeat(first, n)
    whole = np.zeros(len(batch_text), U64)
    some = n > 0
    if len(h):
        whole[some] = W.mix(np.add.reduceat(W.mix(h ^ W.mix(place.astype(U64) + U64(1))), first[some]) + n[some].astype(U64))
    few = some & (n < size)
    return (np.concatenate([runs[inside], whole[few]]), np.concatenate([doc[:len(inside)][inside], np.flatnonzero(few)]), whole)


def signatures(element: np.ndarray, doc: np.ndarray, count: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """n x registers: the element that holds each register; distinct elements per text, each text with one at least.

    A text makes some thousand points however short it is, so texts are taken ``_TEXTS`` at a time.
    """
    out = np.zeros((n, registers), U64)
    edge = np.searchsorted(doc, np.arange(0, n + _TEXTS, _TEXTS))
    for i, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        at = i * _TEXTS
        out[at:at + _TEXTS] = _signatures(element[lo:hi], doc[lo:hi] - at, count[lo:hi], min(_TEXTS, n - at), registers)
    return out


def _signatures(element: np.ndarray, doc: np.ndarray, count: np.ndarray, n: int, registers: int) -> np.ndarray:
    weight = 1.0 + np.log(count)
    total = np.bincount(doc, weights=weight, minlength=n)
    horizon = registers / np.maximum(total, 1e-9) * (np.log(registers) + _FAR)
    out = np.zeros((n, registers), U64)
    todo = np.ones(n, bool)
    while todo.any():
        on = todo[doc]
        e, d, w = element[on], doc[on], weight[on]
        t, step = np.zeros(len(e)), 0
        points: list[tuple] = []
        while len(e):
            r = W.mix(e + U64((0x9E3779B97F4A7C15 * (2 * step + 1)) % 2**64))
            t = t - np.log(((r >> U64(11)).astype(np.float64) + 0.5) / 2.0**53) / w
            live = t <= horizon[d]
            e, d, w, t = e[live], d[live], w[live], t[live]
            slot = d * registers + (W.mix(r[live] + U64(0x632BE59BD9B4E019)) % U64(registers)).astype(np.int64)
            points.append((slot, t, e))
            step += 1
        slot, time, holder = (np.concatenate([p[i] for p in points]) for i in range(3))
        earliest = np.full(n * registers, np.inf)
        np.minimum.at(earliest, slot, time)
        holds = time == earliest[slot]
        flat = out.reshape(-1)
        flat[slot[holds]] = holder[holds]
        # A register that is still empty: this text has to go on for longer.
        todo &= np.isinf(earliest.reshape(n, registers)).any(1)
        horizon[todo] *= 2
    return out


def bands(signature: np.ndarray, number: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(len(signature), number, rows)
    key = np.zeros(parts.shape[:2], U64) + np.arange(number, dtype=U64)
    for i in range(rows):
        key = W.mix(key * U64(0xD6E8FEB86659FD93) + parts[:, :, i])
    return key


def band_keys(element: np.ndarray, doc: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, keys): the different bands of each text, of its plain and of its weighted set."""
    plain = bands(signatures(element, doc, np.ones(len(element)), n))
    again = np.unique(doc[count > 1])
    own = np.isin(doc, again)
    weighted = bands(signatures(element[own], np.searchsorted(again, doc[own]), count[own], len(again)))
    # A band of the same number that is equal is held once.
    new = weighted != plain[again]
    text = np.concatenate([np.repeat(np.arange(n), BANDS), np.repeat(again, new.sum(1))])
    order = np.argsort(text, kind="stable")
    key = np.concatenate([plain.ravel(), weighted[new]])[order]
    return np.searchsorted(text[order], np.arange(n + 1)), key


def parities(element: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and n x PARITY words of the sets ``shingle_sets`` gives; elements ascending within each text."""
    element = element >> U64(32)
    new = np.concatenate([[True], (element[1:] != element[:-1]) | (doc[1:] != doc[:-1])])
    element, doc = element[new], doc[new]
    bits = 64 * PARITY
    fallen = np.bincount(doc * bits + (W.mix(element) % U64(bits)).astype(np.int64), minlength=n * bits)
    odd = (fallen & 1).astype(np.uint8).reshape(n, bits)
    return np.bincount(doc, minlength=n), np.packbits(odd, axis=1).view(np.int64)


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, text_hash, node, size, parity words, bands) of every row that has an id and words; node: hash of the sequence of words."""
    source = _source(docs, text, key).where("id is not null").withColumn("text_hash", F.xxhash64("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "t", _PIECE):
            element, doc, whole = shingles(batch.column("t"))
            element, doc, count = _distinct(element, doc)
            texts, doc = np.unique(doc, return_inverse=True)
            if not len(texts):
                continue
            edge, key = band_keys(element, doc, count, len(texts))
            rows = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(key.view(np.int64)))
            size, parity = parities(element, doc, len(texts))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(texts)), batch.column("text_hash").take(pa.array(texts)), pa.array(whole[texts].view(np.int64)),
                pa.array(size), *[pa.array(np.ascontiguousarray(p)) for p in parity.T], rows], ["id", "text_hash", "node", "size", *ODD, "bands"])

    return source.mapInArrow(run, f"id long, text_hash long, node long, size long, {', '.join(f'{p} long' for p in ODD)}, bands array<long>")


def _source(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, t); an id that is no whole number counts as missing."""
    return docs.select(F.col(key).try_cast("long").alias("id"), F.col(text).cast("string").alias("t"))


def _distinct(element, doc):
    order = np.lexsort((element, doc))
    element, doc = element[order], doc[order]
    head = np.flatnonzero(np.concatenate([[True], (element[1:] != element[:-1]) | (doc[1:] != doc[:-1])])) if len(element) else np.zeros(0, np.int64)
    return element[head], doc[head], np.diff(np.append(head, len(element)))


def wanted_ids(ids: DataFrame, folder: str) -> store.Table:
    """The ids of ``ids`` as sorted hash arrays in the shared folder, mapped by whoever looks one up."""
    bits = store.shard_bits(ids.sparkSession)

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.sort(_id_keys(batch.column("id")))
            yield store.blob_rows((keys >> U64(64 - bits)).astype(np.int64), [keys], bits)

    def write(shard: int, parts: list) -> list:
        keys, = store.stacked(parts, [U64])
        store.save(store.shard_path(folder, "wanted", shard, "key"), np.unique(keys))
        return [[shard, len(keys)]]

    # One row per shard comes back; it says that the files are there.
    store.build(ids.select("id").mapInArrow(blobs, store.BLOBS), bits, write, "shard int, n long").collect()
    return store.Table(folder, "wanted", bits)


def _id_keys(ids: pa.Array) -> np.ndarray:
    """Hashes of whole numbers, different for different ones; close numbers fall into different shards."""
    return W.mix(np.asarray(ids).astype(np.int64).view(U64))


def shingle_sets(docs: DataFrame, wanted: store.Table, text: str, key: str) -> DataFrame:
    """(node, elements): the ascending element hashes (cut to 32 bits) of the texts whose id is wanted.

    The ids are looked up where a text is read, so no text is shuffled. An id may stand on several texts: each gives its set.
    """
    source = _source(docs, text, key).where("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, _ = wanted.match(_id_keys(batch.column("id")))
            for piece in W.pieces(iter([batch.filter(pa.array(found))]), "t", _PIECE):
                element, doc, whole = shingles(piece.column("t"))
                element, doc, _ = _distinct(element >> U64(32), doc)
                parts = np.split(element.astype(np.uint32), np.searchsorted(doc, np.arange(1, piece.num_rows)))
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array([p.tobytes() for p in parts], pa.binary())], ["node", "elements"])

    return source.mapInArrow(run, "node long, elements binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least ``similarity``."""
    both = (pairs.join(sets.withColumnsRenamed({"node": "a", "elements": "ea"}), "a")
            .join(sets.withColumnsRenamed({"node": "b", "elements": "eb"}), "b").select("a", "b", "ea", "eb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ea"), batch.column("eb")):
                p, q = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                low, high = sorted((len(p), len(q)))
                common = len(np.intersect1d(p, q, assume_unique=True)) if low >= similarity * high else 0
                keep.append(common >= similarity * (low + high - common) - 1e-9 and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


class Scratch:
    """Tables of one run in the shared folder. Written once, read with their true size, so Spark broadcasts the small ones."""

    def __init__(self, spark):
        self.spark, self.folder, self.n = spark, shared_folder(spark, "near-duplicates"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"file://{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, class, links) of all nodes of the links (a, b): smallest node of the component, and how many links the node has."""
    both = scratch.keep(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class"), F.count("*").alias("links")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("c"))
        step = label.join(near, "node").select("node", F.least("class", "c").alias("next"), "class", "links")
        jump = label.select(F.col("node").alias("next"), F.col("class").alias("far"))
        after = scratch.keep(step.join(jump, "next").select("node", F.least("next", "far").alias("class"), (F.least("next", "far") != F.col("class")).alias("moved"), "links"))
        label = after.drop("moved")
        if after.where("moved").isEmpty():
            return label


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id, class_size) of every row: ids of one class are linked by similarities of ``similarity`` or more."""
    found = _classes(docs, text, key, similarity, Scratch(docs.sparkSession)).select("id", "class_id", "class_size")
    rest = _source(docs, text, key).where("id is null or t is null or not t rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return found.union(rest.select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def _classes(docs: DataFrame, text: str, key: str, similarity: float, scratch: "Scratch") -> DataFrame:
    """(id, text_hash, class, class_id, class_size) of every row that has an id and words."""
    spark = docs.sparkSession
    sketch = scratch.keep(sketches(docs, text, key))
    # Only (band, node) is dealt out by band; sizes and parities follow for the nodes of the shared buckets.
    bucket = sketch.select("node", F.explode("bands").alias("band"))
    shared = bucket.groupBy("band").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y").select("band")
    place = scratch.keep(bucket.join(scratch.keep(shared), "band", "left_semi").distinct())
    inside = scratch.keep(place.select("node").distinct())
    facts = scratch.keep(sketch.select("id", "node", "size", *ODD).join(inside, "node").groupBy("node").agg(*[F.min(c).alias(c) for c in ("id", "size", *ODD)]))
    sets = scratch.keep(shingle_sets(docs, wanted_ids(facts, scratch.folder), text, key))
    member = scratch.keep(place.join(facts.drop("id"), "node").select("band", "node", "size", *ODD))
    # Sets whose sizes or parities differ too much cannot be alike: exact, and known before any set is read.
    fits = F.least("size", "leader_size") >= similarity * F.greatest("size", "leader_size") - 1e-9
    apart = reduce(add, [F.bit_count(F.col(p).bitwiseXOR(F.col(f"leader_{p}"))) for p in ODD])
    fits &= apart <= (F.col("size") + F.col("leader_size")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    label = spark.createDataFrame([], "node long, class long, links long")
    links = used = tested = None
    leaders = LEADERS
    while True:
        rows = member.select("band", "node", "size", *ODD, F.col("node").alias("class"), F.lit(0).alias("links")) if links is None else scratch.keep(_open(member, label))
        free = rows if used is None else rows.join(used, ["band", "node"], "left_anti")
        order = Window.partitionBy("band").orderBy(F.desc("links"), F.xxhash64("node"), "node")
        lead = scratch.keep(free.withColumn("r", F.row_number().over(order)).where(F.col("r") <= leaders)
                            .select("band", F.col("node").alias("leader"), *[F.col(c).alias(f"leader_{c}") for c in ("size", *ODD)], F.col("class").alias("leader_class")))
        pairs = (rows.join(lead, "band").where((F.col("class") != F.col("leader_class")) & fits)
                 .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
        pairs = scratch.keep(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if lead.isEmpty():
            break
        led = lead.select("band", F.col("leader").alias("node"))
        used, tested = (led, pairs) if used is None else (used.union(led), tested.union(pairs))
        found = scratch.keep(verified(pairs, sets, similarity))
        links = found if links is None else links.union(found)
        if not found.isEmpty():
            label = components(links, scratch)
        leaders *= GROWTH
    named = sketch.select("id", "text_hash", "node").join(label.select("node", "class"), "node", "left").select("id", "text_hash", F.coalesce("class", "node").alias("class"))
    # Classes of one row need no table; the others are joined from a written one, so a hot class can be split.
    sizes = scratch.keep(named.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1"))
    return named.join(sizes, "class", "left").select(
        "id", "text_hash", "class", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def _open(member: DataFrame, label: DataFrame) -> DataFrame:
    """Members of the buckets that still hold more than one class, with class and links."""
    rows = member.join(label, "node", "left").select("band", "node", "size", *ODD, F.coalesce("class", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    mixed = rows.groupBy("band").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x != y").select("band")
    return rows.join(mixed, "band", "left_semi")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One row of every class: the one with the smallest id, and of several texts of that id the one of smallest hash.

    A decision holds for an id together with its text, so a text of its own stays wherever its id stands on another too.
    Rows without id, with an id that is no whole number, or without words stay; of rows equal in id and text one stays.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(_classes(docs, text, key, similarity, scratch).where("class_size > 1"))
    heads = found.where("id = class_id").groupBy("class").agg(F.min("text_hash").alias("head"))
    gone_id, gone_hash = fresh(docs, "gone_id"), fresh(docs, "gone_hash")
    gone = scratch.keep(found.join(scratch.keep(heads), "class").where("id != class_id or text_hash != head")
                        .select(F.col("id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct())
    own_id, own_hash = F.col(key).try_cast("long"), F.xxhash64(F.col(text).cast("string"))
    kept = docs.join(gone, (own_id == F.col(gone_id)) & (own_hash == F.col(gone_hash)), "left_anti")
    # Rows equal in id and text are one class, so they are among the rows found.
    repeated = found.where("id = class_id").groupBy("id", "text_hash").count().where("count > 1").select(
        F.col("id").alias(gone_id), F.col("text_hash").alias(gone_hash))
    repeated = scratch.keep(repeated)
    if repeated.isEmpty():
        return kept
    again = (own_id == F.col(gone_id)) & (own_hash == F.col(gone_hash))
    return kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates([key, text]))
