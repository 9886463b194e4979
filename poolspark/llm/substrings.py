"""Substring dedup by relative Lempel-Ziv parsing against an index of the corpus (operator 5).

Every text is the reference of every other: the index holds each run of ``width`` words that starts at
two or more places, with its first place. A text is then factored greedily from left to right against
all index blocks: a factor is a longest piece whose successive windows lie at successive places of one
source text. A factor is at least ``width`` words long, and since every window of the text is looked up
(not only the one after a factor), nothing is lost where two factors meet.

Three passes over the texts, none of which moves text:

1. Winnowing. Among the ``width - q + 1`` q-word seeds of a window the smallest hashes are its seeds;
   equal windows have equal seeds at equal offsets. Seeds that occur once in the corpus are dropped.
2. Windows with a repeated seed are hashed; those found at two places or more make the index.
3. Parse: factors, and the text without the words that factors cover.

A hash that is very common costs one entry per task and flush, so a passage that a third of the texts
share makes no large group. Seeds and windows are independent 64-bit hashes; a false match needs both
to collide.

Defined results: a null or empty text has no words, no factors and an empty kept text; a row that is
repeated counts as another place; a null key is no hindrance (its source key is 0); other columns of
the input stay as they are, but those named like the outputs are replaced; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolspark.llm import store
from poolspark.llm import words as W

U64 = np.uint64
WIDTH = 35
OUTPUTS = ["n_words", "n_removed", "kept_text", "factors"]
_INDEX = ("src", "at")


def _seed_size(width: int) -> int:
    return max(1, width // 3)


def _seeds(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every seed place, which places are seeds of a window, the seed hash of every window).

    The last one is 0 where the window would leave its text.
    """
    q = _seed_size(width)
    grams = W.run_hashes(hashes, q)
    grams = np.maximum(grams, U64(1))
    reach = width - q + 1
    lowest = W.slide(grams, reach)
    lowest = np.where(W.within(doc, width), lowest, U64(0))
    # Place i is a seed if a window that holds it has its hash as the smallest.
    padded = np.concatenate([np.zeros(reach - 1, U64), lowest, np.zeros(reach - 1, U64)])
    chosen = W.slide(padded, reach, np.maximum) == grams
    return grams, chosen, lowest


def _words(batch: pa.RecordBatch, text: str):
    data, offsets = W.texts(batch.column(text))
    start, end, doc = W.spans(data, offsets)
    return data, start, end, doc, W.span_hashes(data, start, end)


def _flushed(stream, reduce, bits):
    """Gather (key, ...) arrays of a task and hand them on, reduced, every FLUSH keys."""
    held, n = [], 0
    for arrays in stream:
        held.append(arrays)
        n += len(arrays[0])
        if n >= store.FLUSH:
            yield store.blob_rows(*reduce(held), bits)
            held, n = [], 0
    if n:
        yield store.blob_rows(*reduce(held), bits)


def _places(parts: list) -> list[np.ndarray]:
    """Per key: the smallest (source, place), and whether there are two places or more."""
    key, src, at, many = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((at, src, key))
    key, src, at, many = key[order], src[order], at[order], many[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    many = (np.maximum.reduceat(many, first) if len(key) else many) | (size > 1).astype(np.uint8)
    return [key[first], src[first], at[first], many.astype(np.uint8)]


class Index:
    """Repeated seeds and repeated windows of a corpus, as sorted hash arrays in the shared folder."""

    def __init__(self, folder: str, bits: int, width: int):
        self.width, self.bits, self.folder = width, bits, folder
        self.seeds = store.Table(folder, "seed", bits)
        self.windows = store.Table(folder, "window", bits, _INDEX)

    def repeated(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows whose seed is repeated, their hashes)."""
        grams, chosen, lowest = _seeds(hashes, doc, self.width)
        distinct = np.unique(W.mix(grams[chosen]))
        hit = np.sort(distinct[self.seeds.find(distinct)[0]])
        if not len(hit):
            return np.zeros(0, np.int64), np.zeros(0, U64)
        # Only where the seed changes is there anything to look up.
        turn = np.flatnonzero(np.concatenate([[True], lowest[1:] != lowest[:-1]]))
        mine = W.mix(lowest[turn])
        good = (hit[np.minimum(np.searchsorted(hit, mine), len(hit) - 1)] == mine) & (lowest[turn] > 0)
        at = np.flatnonzero(np.repeat(good, np.diff(np.append(turn, len(lowest)))))
        return at, W.run_hashes(hashes, self.width)[at]


def build_index(docs: DataFrame, width: int = WIDTH, text: str = "text", key: str = "doc_id") -> Index:
    """Index every text of ``docs``; two jobs, each ending in files of the shared folder."""
    spark = docs.sparkSession
    bits = store.shard_bits(spark)
    folder = store.shared_folder(spark, "substrings")
    index = Index(folder, bits, width)
    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k"), F.col(text).cast("string").alias("t"))

    def seeds(batches):
        def reduce(held):
            keys, n = W.counted(np.concatenate([h[0] for h in held]))
            return (keys >> U64(64 - bits)).astype(np.int64), [keys, (n > 1).astype(np.uint8)]

        def stream():
            for batch in W.pieces(batches, "t"):
                _, _, _, doc, hashes = _words(batch, "t")
                grams, chosen, _ = _seeds(hashes, doc, width)
                yield [W.mix(grams[chosen])]

        yield from _flushed(stream(), reduce, bits)

    def write_seeds(shard, parts):
        keys, many = store.stacked(parts, [U64, np.uint8])
        keys, n = store.summed(keys, many.astype(np.int64) + 1)
        keys = keys[n > 1]
        store.save(store.shard_path(folder, "seed", shard, "key"), keys)
        return [[shard, len(keys)]]

    def windows(batches):
        def reduce(held):
            out = _places([[h[0], h[1], h[2], np.zeros(len(h[0]), np.uint8)] for h in held])
            return (out[0] >> U64(64 - bits)).astype(np.int64), out

        def stream():
            for batch in W.pieces(batches, "t"):
                _, _, _, doc, hashes = _words(batch, "t")
                at, keys = index.repeated(hashes, doc)
                first = np.searchsorted(doc, np.arange(batch.num_rows))
                ids = np.asarray(batch.column("k"))
                yield [keys, ids[doc[at]], (at - first[doc[at]]).astype(np.uint32)]

        yield from _flushed(stream(), reduce, bits)

    def write_windows(shard, parts):
        if not parts:
            parts = [[np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)]]
        key, src, at, many = _places(parts)
        keep = many > 0
        for name, column in (("key", key), ("src", src), ("at", at)):
            store.save(store.shard_path(folder, "window", shard, name), column[keep])
        return [[shard, int(keep.sum())]]

    # One row per shard comes back; it says that the files are there.
    store.build(source.mapInArrow(seeds, store.BLOBS), bits, write_seeds, "shard int, n long").collect()
    store.build(source.mapInArrow(windows, store.BLOBS), bits, write_windows, "shard int, n long").collect()
    return index


def parse(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """Factor every text against the index.

    Adds ``n_words``, ``n_removed`` (words that factors cover), ``kept_text`` (the other words, joined
    by one space) and ``factors``: array of (start, length, source, source_start), in words.
    """
    kept = [c for c in docs.columns if c not in OUTPUTS]
    spark_schema = docs.select(*kept).schema
    factor = "array<struct<start:int,length:int,source:bigint,source_start:int>>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in spark_schema]
                       + ["n_words bigint", "n_removed bigint", "kept_text string", f"factors {factor}"])
    width = index.width
    item = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, text):
            n = batch.num_rows
            data, start, end, doc, hashes = _words(batch, text)
            at, keys = index.repeated(hashes, doc)
            found, place = index.windows.match(keys)
            at, src, pos = at[found], place["src"][found], place["at"][found].astype(np.int64)
            mark = np.zeros(len(start) + 1, np.int64)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + width, -1)
            covered = np.cumsum(mark[:-1]) > 0
            keep = ~covered
            opens = np.ones(len(at), bool)
            opens[1:] = (at[1:] != at[:-1] + 1) | (src[1:] != src[:-1]) | (pos[1:] != pos[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
            head = np.flatnonzero(opens)
            length = np.diff(np.append(head, len(at))) + width - 1
            first = np.searchsorted(doc, np.arange(n + 1))
            rows = pa.StructArray.from_arrays(
                [pa.array((at[head] - first[doc[at[head]]]).astype(np.int32)), pa.array(length.astype(np.int32)),
                 pa.array(src[head]), pa.array(pos[head].astype(np.int32))], fields=list(item))
            edge = np.searchsorted(doc[at[head]], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(np.diff(first)),
                 pa.array(np.bincount(doc[covered], minlength=n).astype(np.int64)),
                 W.join_words(data, start[keep], end[keep], doc[keep], n),
                 pa.ListArray.from_arrays(pa.array(edge), rows)],
                [*kept, *OUTPUTS])

    return docs.select(*kept).mapInArrow(run, schema)


def dedup_substrings(docs: DataFrame, width: int = WIDTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the outputs of ``parse`` against the index of ``docs`` itself."""
    return parse(docs, build_index(docs, width, text, key), text)
