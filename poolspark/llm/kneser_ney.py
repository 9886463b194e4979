"""Interpolated modified Kneser-Ney word model: counted in Spark, scored from mapped hash arrays (operator 1).

The model has two orders. Its tables lie in the shared folder, in shards of sorted 64-bit hashes:

* ``word``: how often each token occurs, and after how many different tokens it occurs;
* ``context``: after each token, how many different tokens occur once, twice, three times or more;
* ``pair``: how often each pair of successive tokens occurs (a byte; ``often`` holds larger counts).

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + left(v) * p(w),   left(v) = (D1 n1(v) + D2 n2(v) + D3 n3(v)) / c(v)
    p(w)     = max(n(.w) - D'(n(.w)), 0) / pairs + left' / (V + 1)

The last term is shared evenly by the V known tokens and one class for all unknown ones, so that the
probabilities of a context add up to one. A context that was never seen leaves everything to p(w).
Discounts come from the counts of counts of each level.

Counting gathers one entry per distinct pair, task and flush. Pairs are dealt to shards by their first
token; a token that makes up more than a quarter of an average shard is dealt to several, by the second
token, and its few sums are added up afterwards, so a very common word is no hot key.

Tokens: words between white space, A-Z in lower case, then one end token per text. Log probabilities are
added up in whole steps of 1e-7, so that a sum does not depend on the order of the rows.

Defined results: a null or empty text is the end token alone; an empty training set gives N = V = 0, base
and model then leave everything to the unknown class (score 0 for its log10(1)); repeated rows count each
time; other columns stay as they are, those named like outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolspark.llm import store
from poolspark.llm import words as W

U64 = np.uint64
END, START = W.mix(np.array([1, 2], U64))
STEP = 1e7  # log10 probabilities are rounded to 1 / STEP before they are added
OUTPUTS = ["n_tokens", "n_known", "base_score", "score"]
_PAIR = U64(0xD6E8FEB86659FD93)


def tokens(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the words of each text, each text closed by END."""
    data, offsets = W.texts(batch.column(text))
    data = W.translated(data, W.LOWER)
    start, end, doc = W.spans(data, offsets)
    n = np.bincount(doc, minlength=batch.num_rows) + 1
    size = len(start) + batch.num_rows
    last = np.cumsum(n) - 1
    out = np.full(size, END, U64)
    word = np.ones(size, bool)
    word[last] = False
    out[word] = W.span_hashes(data, start, end)
    return out, np.repeat(np.arange(batch.num_rows), n)


def before(token: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The token in front of each, START at the head of a text."""
    out = np.empty_like(token)
    out[1:] = token[:-1]
    head = np.ones(len(token), bool)
    head[1:] = doc[1:] != doc[:-1]
    out[head] = START
    return out


def discounts(counts: list[int]) -> list[float]:
    """D1, D2, D3+ from how many entries have a count of 1, 2, 3 and 4."""
    n1, n2, n3, n4 = counts
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a else k * y
        out.append(min(max(d, 0.05), k - 0.05))  # some mass for what was not seen, and never more than there is
    return out


def take_off(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.where(n > 2, d[2], np.where(n == 2, d[1], np.where(n == 1, d[0], 0.0)))


@dataclass
class Model:
    folder: str
    bits: int
    tokens: int  # N
    kinds: int  # V
    pairs: int
    spread: dict[str, np.ndarray]  # hot tokens (ascending) and over how many shards their pairs are dealt
    upper: list[float]
    lower: list[float]
    left: float = 0.0

    def __post_init__(self):
        self.word = store.Table(self.folder, "word", self.bits, ("n", "after"))
        self.context = store.Table(self.folder, "context", self.bits, ("n1", "n2", "n3"))
        self.pair = store.Table(self.folder, "pair", self.bits, ("n",))
        self.often = store.Table(self.folder, "often", self.bits, ("n",))

    def score(self, token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, base log10 probability, model's log10 probability) of every token."""
        known, w = self.word.match(token)
        base = np.log10((w["n"] + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))
        low = (np.maximum(w["after"] - take_off(w["after"], self.lower), 0) + self.left / (self.kinds + 1)) / max(self.pairs, 1)
        if not self.pairs:
            low = np.ones(len(token))
        first = before(token, doc)
        distinct, back = np.unique(first, return_inverse=True)
        _, own = self.word.find(distinct)
        seen = np.where(distinct == START, self.word.find(np.array([END], U64))[1]["n"][0], own["n"])  # as many starts as ends
        _, c = self.context.find(distinct)
        mass = (self.upper[0] * c["n1"] + self.upper[1] * c["n2"] + self.upper[2] * c["n3"]) / np.maximum(seen, 1)
        mass = np.where(seen > 0, mass, 1.0)
        keys = pair_keys(first, token, self.spread, self.bits)
        n = self.counts(keys).astype(np.float64)
        p = np.maximum(n - take_off(n, self.upper), 0) / np.maximum(seen, 1)[back] + mass[back] * low
        return known, base, np.log10(p)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(keys, return_inverse=True)
        n = self.pair.find(distinct)[1]["n"].astype(np.int64)
        full = np.flatnonzero(n == 255)
        n[full] = self.often.find(distinct[full])[1]["n"]
        return n[back]


def pair_keys(first: np.ndarray, second: np.ndarray, spread: dict, bits: int) -> np.ndarray:
    """Key of a pair; its top bits name the shard that the pair is dealt to."""
    shard = shards_of(first, second, spread, bits)
    return (shard << U64(64 - bits)) | (W.mix(first * _PAIR + second) >> U64(bits))


def shards_of(first: np.ndarray, second: np.ndarray, spread: dict, bits: int) -> np.ndarray:
    shard = first >> U64(64 - bits)
    hot, over = spread["token"], spread["over"]
    if len(hot):
        at = np.minimum(np.searchsorted(hot, first), len(hot) - 1)
        is_hot = hot[at] == first
        shard[is_hot] = (shard[is_hot] + (second[is_hot] >> U64(7)) % over[at[is_hot]]) & U64((1 << bits) - 1)
    return shard


def _class_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Count all texts of ``docs``; three jobs, each ending in files and one row per shard."""
    spark = docs.sparkSession
    bits = store.shard_bits(spark)
    shards = 1 << bits
    folder = store.shared_folder(spark, "kneser-ney")
    source = docs.select(F.col(text).cast("string").alias("t"))

    def path(table, shard, column):
        return store.shard_path(folder, table, shard, column)

    # Tokens.
    def count_tokens(batches):
        held, n = [], 0
        for batch in W.pieces(batches, "t"):
            held.append(tokens(batch, "t")[0])
            n += len(held[-1])
            if n >= store.FLUSH:
                yield emit_tokens(held)
                held, n = [], 0
        if held:
            yield emit_tokens(held)

    def emit_tokens(held):
        keys, n = W.counted(np.concatenate(held))
        return store.blob_rows((keys >> U64(64 - bits)).astype(np.int64), [keys, n.astype(np.uint32)], bits)

    def write_tokens(shard, parts):
        keys, n = store.summed(*store.stacked(parts, [U64, np.uint32]))
        store.save(path("word", shard, "raw"), keys)
        store.save(path("word", shard, "rawn"), n)
        top = np.argsort(-n, kind="stable")[:16]
        top = np.sort(top[n[top] * 16 >= n.sum()])  # at most 16 tokens hold a sixteenth each
        return [[shard, len(keys), int(n.sum()), store.pack([keys[top], n[top]])]]

    rows = store.build(source.mapInArrow(count_tokens, store.BLOBS), bits, write_tokens, "shard int, kinds long, n long, top binary").collect()
    total, kinds = sum(r.n for r in rows), sum(r.kinds for r in rows)
    hot = sorted((int(k), min(shards, -(-4 * shards * int(n) // total))) for r in rows for k, n in zip(*store.unpack(r.top))
                 if 4 * shards * int(n) > total)
    ends = next((int(n) for r in rows for k, n in zip(*store.unpack(r.top)) if U64(k) == END), 0)
    if ends * 4 * shards > total:  # texts of few words: START is as hot as END
        hot = sorted([*hot, (int(START), min(shards, -(-4 * shards * ends // total)))])
    spread = {"token": np.array([k for k, _ in hot], U64), "over": np.array([n for _, n in hot], U64)}

    # Pairs: the first tokens once per run of equal ones, the second ones, and the counts.
    def count_pairs(batches):
        held, n = [], 0
        for batch in W.pieces(batches, "t"):
            token, doc = tokens(batch, "t")
            held.append((before(token, doc), token))
            n += len(token)
            if n >= store.FLUSH:
                yield emit_pairs(held)
                held, n = [], 0
        if held:
            yield emit_pairs(held)

    def emit_pairs(held):
        first, second = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.argsort(W.mix(first * _PAIR + second))
        first, second = first[order], second[order]
        head = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
        n = np.diff(np.append(head, len(first))).astype(np.uint32)
        first, second = first[head], second[head]
        shard = shards_of(first, second, spread, bits)
        order = np.lexsort((second, first, shard))
        shard, first, second, n = shard[order].astype(np.int64), first[order], second[order], n[order]
        edge = np.searchsorted(shard, np.arange(shards + 1))
        some = np.flatnonzero(edge[1:] > edge[:-1])
        blobs = []
        for s in some:
            a, b, c = (x[edge[s]:edge[s + 1]] for x in (first, second, n))
            at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            blobs.append(store.pack([a[at], np.diff(np.append(at, len(a))).astype(np.uint32), b, c]))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), 4, np.int32)), pa.array(blobs, pa.binary())],
                                          ["shard", "part", "blob"])

    def write_pairs(shard, parts):
        first = np.concatenate([np.repeat(p[0], p[1]) for p in parts]) if parts else np.zeros(0, U64)
        second = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, U64)
        n = np.concatenate([p[3] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        parts.clear()
        order = np.lexsort((second, first))
        first, second, n = first[order], second[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])) if len(n) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, head) if len(n) else n
        first, second = first[head], second[head]
        keys = pair_keys(first, second, spread, bits)
        order = np.argsort(keys)
        store.save(path("pair", shard, "key"), keys[order])
        store.save(path("pair", shard, "n"), np.minimum(n, 255)[order].astype(np.uint8))
        large = order[n[order] >= 255]
        store.save(path("often", shard, "key"), keys[large])
        store.save(path("often", shard, "n"), n[large])
        # What the pairs of the shard say about first tokens; those dealt to several shards go to the driver, few as they are.
        at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.zeros(0, np.int64)
        sums = [np.add.reduceat((n == k).astype(np.int64) if k < 3 else (n > 2).astype(np.int64), at) if len(at) else at for k in (1, 2, 3)]
        context = first[at]
        is_hot = np.isin(context, spread["token"])
        for name, column in (("key", context), ("n1", sums[0]), ("n2", sums[1]), ("n3", sums[2])):
            store.save(path("context-own", shard, name), column[~is_hot])
        shared = store.pack([context[is_hot], *[s[is_hot] for s in sums]])
        # After how many different tokens each token occurs, for the last job.
        after, m = np.unique(second, return_counts=True)
        store.save(path("after", shard, "key"), after)
        store.save(path("after", shard, "n"), m.astype(np.uint32))
        c = _class_counts(n)
        return [[shard, len(keys), *c, shared]]

    rows = store.build(source.mapInArrow(count_pairs, store.BLOBS), bits, write_pairs,
                       "shard int, pairs long, c1 long, c2 long, c3 long, c4 long, shared binary").collect()
    pairs = sum(r.pairs for r in rows)
    upper = discounts([sum(r[f"c{k}"] for r in rows) for k in (1, 2, 3, 4)])
    parts = [store.unpack(r.shared) for r in rows]
    hot_keys = np.concatenate([p[0] for p in parts])
    hot_sums = [store.summed(hot_keys, np.concatenate([p[i] for p in parts])) for i in (1, 2, 3)]

    # Each shard's list of second tokens goes to the shards of those tokens.
    def send(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                keys, n = (np.load(path("after", shard, c)) for c in ("key", "n"))
                yield store.blob_rows((keys >> U64(64 - bits)).astype(np.int64), [keys, n], bits)

    def write_after(shard, parts):
        keys, n = store.summed(*store.stacked(parts, [U64, np.uint32]))
        raw, count = np.load(path("word", shard, "raw")), np.load(path("word", shard, "rawn"))
        after = np.zeros(len(raw), np.int64)
        after[np.searchsorted(raw, keys)] = n  # every second token is a token
        for name, column in (("key", raw), ("n", count), ("after", after)):
            store.save(path("word", shard, name), column)
        context = [np.load(path("context-own", shard, c)) for c in ("key", "n1", "n2", "n3")]
        mine = hot_sums[0][0] >> U64(64 - bits) == shard
        context = [np.concatenate([context[0], hot_sums[0][0][mine]]), *[np.concatenate([context[i], hot_sums[i - 1][1][mine]]) for i in (1, 2, 3)]]
        order = np.argsort(context[0])
        for name, column in zip(("key", "n1", "n2", "n3"), context):
            store.save(path("context", shard, name), column[order])
        return [[shard, *_class_counts(after), int((after > 2).sum())]]

    rows = store.build(spark.range(0, shards, 1, shards).mapInArrow(send, store.BLOBS), bits, write_after,
                       "shard int, c1 long, c2 long, c3 long, c4 long, more long").collect()
    c = [sum(r[f"c{k}"] for r in rows) for k in (1, 2, 3, 4)]
    lower = discounts(c)
    left = lower[0] * c[0] + lower[1] * c[1] + lower[2] * sum(r.more for r in rows)
    return Model(folder, bits, total, kinds, pairs, spread, upper, lower, left)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``n_known``, ``base_score`` and ``score`` (log10) to every row.

    Perplexity is ``10 ** (-score / n_tokens)``.
    """
    kept = [c for c in docs.columns if c not in OUTPUTS]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
                       + ["n_tokens bigint", "n_known bigint", "base_score double", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, text):
            token, doc = tokens(batch, text)
            known, base, own = model.score(token, doc)
            edge = np.searchsorted(doc, np.arange(batch.num_rows))
            sums = [np.add.reduceat(np.rint(x * STEP).astype(np.int64), edge) / STEP for x in (base, own)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(np.bincount(doc, minlength=batch.num_rows).astype(np.int64)),
                 pa.array(np.add.reduceat(known.astype(np.int64), edge)), *[pa.array(s) for s in sums]], [*kept, *OUTPUTS])

    return docs.select(*kept).mapInArrow(run, schema)
