"""Benchmark decontamination by CGK embedding and bit sampling (operator 2).

A text is contaminated by an item if some stretch of it is within ``share`` of the item's length in edit
distance (characters; A-Z in lower case, white space as one space). Exact and lightly edited copies are found
wherever they stand in a text.

Windows are laid so that no match can be missed: an item with a limit of k edits is cut into k + 1 pieces, one of
which stands unchanged in every match. A window as long as the item is laid where a piece stands, at the place the piece
has in the item. An edit destroys a bounded number of the item's runs of ``GRAM`` bytes, so windows that hold too few of
them are dropped; that loses nothing either. The rest and the items go through the same CGK random walks: at every step
the walk writes the byte under its pointer and a coin that depends on step and byte says whether to move on; strings at a
small edit distance soon fall back into step, so edit distance becomes Hamming distance. Each table samples ``BITS``
places of a walk; a window is a candidate if any table agrees with the item's. How many tables reach the target recall
follows, for each class of item lengths, from how often walks of its items and of copies edited to the limit agree; where
no number up to ``TABLES`` does, or items are longer than ``LONGEST``, every window of the class is a candidate.
Candidates are verified by exact edit distance, so the result has no false matches.

Items are taken in blocks of bounded size (``BLOCK_BYTES``), each broadcast and matched in one pass over the texts,
so a large benchmark costs passes, not memory.

Defined results: null or empty texts and items match nothing; an item that is repeated matches each time under its
own id, rows that are repeated match alike; the text column and the key are all that is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolspark.llm import words as W

U64 = np.uint64
SHARE = 0.1
RECALL = 0.98
GRAM = 5
BITS = 4
WALKS = 16
TABLES = 256
LONGEST = 8192
STRETCH = 2  # steps of a walk per byte: half of them move on, so that a third would show the end of the string only
BLOCK_BYTES = 4 << 20
_WINDOWS = 2048  # windows looked at at once
_KEY = 8  # bytes of a piece that are looked up
_MARKS = 4096  # bits that mark the grams of an item
_SPREAD = U64(0x9E3779B97F4A7C15)


def normal_form(text: str) -> str:
    return b" ".join(text.encode().translate(W.LOWER).split(None)).decode()  # bytes.split knows the same white space, and 0x0B


def distance_within(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any stretch of the text, and where that ends (bit-parallel)."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at + len(pattern)
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    up, down, score = mask, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = equal.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & mask
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        up = mh | ~(xv | ph) & mask
        down = ph & xv
        if score < best:
            best, end = score, j
    return best, end


@lru_cache(1)
def _coins() -> np.ndarray:
    return np.stack([np.random.default_rng([7, walk]).integers(0, 2, (STRETCH * 1024, 256), np.uint8) for walk in range(WALKS)])


def embed(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Steps x walks x rows: what each walk writes, ``STRETCH`` x size bytes, 0 once the pointer has left the row."""
    n, width = rows.shape
    steps = STRETCH * int(size.max()) if n else 0
    coins, walk = _coins(), np.arange(WALKS)[:, None]
    padded = np.concatenate([rows, np.zeros((n, 1), np.uint8)], 1).ravel()
    base = np.arange(n) * (width + 1)
    limit = base + size
    out = np.empty((steps, WALKS, n), np.uint8)
    at = np.tile(base, (WALKS, 1))
    for j in range(steps):
        byte = padded[at]
        out[j] = byte
        at += coins[:, j % coins.shape[1]][walk, byte]
        np.minimum(at, limit, out=at)
    return out


def samples(tables: int) -> np.ndarray:
    """Sampled places of every table, as shares of a walk's length."""
    return np.random.default_rng(11).random((tables, BITS)) * 0.9


def signatures(rows: np.ndarray, size: np.ndarray, tables: int) -> np.ndarray:
    """rows x tables: the bytes at the sampled places of each table's walk, in one number."""
    out = np.zeros((len(rows), tables), np.int64)
    for part in np.array_split(np.argsort(size, kind="stable"), max(1, -(-len(rows) // 512))):  # rows of like size share a matrix
        own = size[part]
        output = embed(rows[part, :int(own.max()) if len(part) else 0], own)
        for t, places in enumerate(samples(tables)):
            for p in places:
                out[part, t] = out[part, t] * 256 + output[(p * STRETCH * own).astype(np.int64), t % WALKS, np.arange(len(part))]
    return out


def as_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(size.max()) if len(texts) else 0), np.uint8)
    for row, t in zip(out, texts):
        row[:len(t)] = np.frombuffer(t, np.uint8)
    return out, size


def tables_for(items: list[str], share: float, recall: float) -> int:
    """Tables that reach the recall for copies edited to the limit and laid a few bytes off, from their measured agreement; 0 if none do."""
    rng = np.random.default_rng(5)
    picked = [items[i] for i in rng.permutation(len(items))[:200]]
    if max(len(t.encode()) for t in picked) > LONGEST:
        return 0
    edited = []
    for t in picked:
        chars = list(t)
        for _ in range(int(share * len(t))):
            kind, at = rng.integers(0, 3), int(rng.integers(0, len(chars))) if chars else 0
            if kind == 0 and chars:
                chars[at] = chr(97 + rng.integers(0, 26))
            elif kind == 1 and chars:
                del chars[at]
            else:
                chars.insert(at, chr(97 + rng.integers(0, 26)))
        off = int(rng.integers(-6, 7))  # edits in front of a piece move its window
        edited.append("e" * off + "".join(chars[max(0, -off):]))
    (a, n), (b, _) = as_rows([t.encode() for t in picked]), as_rows([t.encode() for t in edited])
    b = np.pad(b, ((0, 0), (0, max(0, a.shape[1] - b.shape[1]))))[:, :max(a.shape[1], 1)]
    own = (signatures(a, n, TABLES) == signatures(b, n, TABLES)).mean(1)  # of each pair: share of tables that agree
    reached = [(1 - (1 - own) ** tables).mean() >= recall for tables in range(8, TABLES + 1)]
    return 8 + reached.index(True) if True in reached else 0


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number; 0 after the end."""
    padded = np.concatenate([data, np.zeros(_KEY, np.uint8)])
    return np.ndarray(len(data), "<u8", padded, 0, (1,)).astype(U64)


def _head(eights: np.ndarray, size: int) -> np.ndarray:
    return eights & U64((1 << 8 * size) - 1)


def _grams(eights: np.ndarray) -> np.ndarray:
    return (_head(eights, GRAM) * _SPREAD >> U64(52)).astype(np.int64)


@dataclass
class Block:
    """Items that are matched together."""

    ids: list
    texts: list[str]
    size: np.ndarray  # per item: bytes, most edits, fewest grams that a match holds
    limit: np.ndarray
    least: np.ndarray
    marks: np.ndarray  # items x bytes: bits of the grams
    pieces: dict[int, tuple]  # by bytes looked up: (first bytes, last bytes, size, item, offset), ascending by first bytes
    tables: np.ndarray  # per item; 0: no sampling
    signature: np.ndarray

    @staticmethod
    def of(rows: list[tuple], share: float, recall: float) -> "Block":
        texts = [normal_form(t) for _, t in rows]
        raw = [t.encode() for t in texts]
        size = np.array([len(t) for t in raw], np.int64)
        limit = np.array([int(share * len(t)) for t in texts], np.int64)
        # An edit of a character destroys the grams that reach into it.
        widest = np.array([max(len(c.encode()) for c in set(t)) for t in texts], np.int64)
        least = size - (GRAM - 1) - limit * (GRAM - 1 + widest)
        marks = np.zeros((len(raw), _MARKS // 8), np.uint8)
        parts: dict[int, list] = {}
        for i, (t, b) in enumerate(zip(texts, raw)):
            g = _grams(_eights(np.frombuffer(b, np.uint8)))[:max(0, len(b) - GRAM + 1)]
            np.bitwise_or.at(marks[i], g >> 3, (1 << (g & 7)).astype(np.uint8))
            n, at = int(limit[i]) + 1, 0
            for j in range(n):
                piece = t[len(t) * j // n:len(t) * (j + 1) // n].encode()
                if piece:
                    key = min(len(piece), _KEY)
                    parts.setdefault(key, []).append((int.from_bytes(piece[:key], "little"), int.from_bytes(piece[-key:], "little"), len(piece), i, at))
                at += len(piece)
        pieces = {}
        for key, found in parts.items():
            first, last, length, item, offset = zip(*sorted(found))
            pieces[key] = (np.array(first, U64), np.array(last, U64), *(np.array(x, np.int64) for x in (length, item, offset)))
        tables = np.zeros(len(raw), np.int64)
        kind = np.array([int(n).bit_length() for n in size])
        for k in np.unique(kind):
            tables[kind == k] = tables_for([texts[i] for i in np.flatnonzero(kind == k)], share, recall)
        signature = np.zeros((len(raw), int(tables.max())), np.int64)
        for k in np.unique(kind[tables > 0]):
            own = np.flatnonzero((kind == k) & (tables > 0))
            signature[own, :tables[own[0]]] = signatures(*as_rows([raw[i] for i in own]), int(tables[own[0]]))
        return Block([i for i, _ in rows], texts, size, limit, least, marks, pieces, tables, signature)

    def hits(self, eights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, size, item, offset in the item) of every piece of an item; places in the text may cross its end."""
        out = [(np.zeros(0, np.int64),) * 4]
        for key, (first, last, size, item, offset) in self.pieces.items():
            head = _head(eights, key)
            place = _member(head, first)
            lo, hi = np.searchsorted(first, head[place], "left"), np.searchsorted(first, head[place], "right")
            n = hi - lo
            stop = np.cumsum(n)
            at = np.repeat(lo - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)
            place = np.repeat(place, n)
            tail = place + size[at] - key
            same = (tail < len(head)) & (head[np.minimum(tail, len(head) - 1)] == last[at])
            out.append((place[same], size[at[same]], item[at[same]], offset[at[same]]))
        return tuple(np.concatenate(x) for x in zip(*out))


def blocks(benchmark: DataFrame, text: str, item: str, share: float, recall: float) -> Iterator[Block]:
    """Items in blocks of ``BLOCK_BYTES`` at most (or one item); partition by partition, never all at once."""
    held, size = [], 0
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null").toLocalIterator():
        if not normal_form(row.t):
            continue
        if held and size + len(row.t.encode()) > BLOCK_BYTES:
            yield Block.of(held, share, recall)
            held, size = [], 0
        held.append((row.i, row.t))
        size += len(row.t.encode())
    if held:
        yield Block.of(held, share, recall)


def _normal(batch: pa.RecordBatch, column: str):
    """Normal form of each text: (bytes, text offsets)."""
    data, offsets = W.texts(batch.column(column))
    low = W.translated(data, W.LOWER)
    start, end, doc = W.spans(low, offsets)
    return W.texts(W.join_words(low, start, end, doc, batch.num_rows))


def _member(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the values that are among the wanted ones (ascending); most are ruled out by a bit table."""
    shift = U64(44 if len(wanted) < 1 << 16 else 38)
    bits = np.zeros(1 << 64 - int(shift), bool)
    bits[(wanted * _SPREAD >> shift).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(values * _SPREAD >> shift).astype(np.int64)])
    at = np.minimum(np.searchsorted(wanted, values[maybe]), len(wanted) - 1)
    return maybe[wanted[at] == values[maybe]]


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, recall: float = RECALL, text: str = "text", key: str = "doc_id",
            item: str = "item_id") -> DataFrame:
    """(key, item, edits, start_word): one row per row of ``docs`` and item found in it, at its best place."""
    found = [_matches(docs, b, text, key, item, benchmark) for b in blocks(benchmark, text, item, share, recall)]
    kind = benchmark.schema[item].dataType.simpleString()
    if not found:
        return docs.sparkSession.createDataFrame([], f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` {kind}, edits int, start_word int")
    return reduce(DataFrame.unionByName, found)


def _matches(docs, block, text, key, item, benchmark):
    source = docs.select(F.col(key), F.col(text).cast("string").alias("__t"))
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kinds = [docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()]
    ids = pa.array(block.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in W.pieces(batches, "__t"):
            data, offsets = _normal(batch, "__t")
            doc, which, begin = _windows(data, offsets, own)
            start, _, of = W.spans(data, offsets) if len(doc) else (None, None, None)
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for i in range(len(doc)):
                d, w = int(doc[i]), int(which[i])
                pattern, limit = own.texts[w], int(own.limit[w])
                if best.get((d, w), (limit + 1,))[0] == 0:
                    continue
                low, high = _stretch(offsets, doc[i], which[i], begin[i], own)
                edits, _ = distance_within(pattern, data[low:high].tobytes().decode("utf-8", "ignore"))
                if edits <= limit:
                    first, last = np.searchsorted(of, [d, d + 1])
                    near = first + int(np.argmin(np.abs(start[first:last] - begin[i])))  # the word nearest to where the window begins
                    best[d, w] = min(best.get((d, w), (limit + 1, 0)), (edits, int(near - first)))
            rows = sorted(best.items())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array([d for (d, _), _ in rows], pa.int64())), ids.take(pa.array([w for (_, w), _ in rows], pa.int64())),
                 pa.array([e for _, (e, _) in rows], pa.int32()), pa.array([p for _, (_, p) in rows], pa.int32())], [key, item, "edits", "start_word"])

    return source.mapInArrow(run, f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, edits int, start_word int")


def _stretch(offsets, doc, which, begin, own):
    """Bytes of a text that hold every match which the window may stand for: edits in front of a piece move it by 4 bytes each at most."""
    slack = 4 * own.limit[which] + 4
    return np.maximum(offsets[doc], begin - slack), np.minimum(offsets[doc + 1], begin + own.size[which] + slack)


def _windows(data: np.ndarray, offsets: np.ndarray, own: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, first byte) of the windows that are candidates, by text and item."""
    eights = _eights(data)
    place, size, item, offset = own.hits(eights)
    doc = np.searchsorted(offsets, place, "right") - 1
    inside = place + size <= offsets[np.minimum(doc + 1, len(offsets) - 1)]
    doc, item, begin = doc[inside], item[inside], (place - offset)[inside]
    order = np.lexsort((begin, doc, item))
    doc, item, begin = doc[order], item[order], begin[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] != begin[:-1])
    doc, item, begin = doc[new], item[new], begin[new]
    if len(doc):
        gram = _grams(eights)
        cell, bit = (gram >> 3).astype(np.int16), (1 << (gram & 7)).astype(np.uint8)
        keep = np.zeros(len(doc), bool)
        for c in range(0, len(doc), _WINDOWS):
            part = slice(c, c + _WINDOWS)
            low, high = _stretch(offsets, doc[part], item[part], begin[part], own)
            at = low[:, None] + np.arange(int((high - low).max()))
            whole = at <= (high - GRAM)[:, None]
            at = np.minimum(at, len(data) - 1)
            found = (own.marks[item[part][:, None], cell[at]] & bit[at] != 0) & whole
            keep[part] = found.sum(1) >= own.least[item[part]]
        doc, item, begin = doc[keep], item[keep], begin[keep]
    if len(doc):
        keep = _candidates(data, offsets, doc, item, begin, own)
        doc, item, begin = doc[keep], item[keep], begin[keep]
    order = np.lexsort((begin, item, doc))
    return doc[order], item[order], begin[order]


def _candidates(data, offsets, doc, which, begin, own) -> np.ndarray:
    """Windows whose walk agrees with the item's in a table, or whose item is not sampled."""
    out = own.tables[which] == 0
    for tables in np.unique(own.tables[which[~out]]):
        same = np.flatnonzero(own.tables[which] == tables)
        for part in np.array_split(same, -(-len(same) // _WINDOWS)):
            size = own.size[which[part]]
            width = np.arange(int(size.max()))
            at = np.maximum(begin[part], offsets[doc[part]])
            rows = data[np.minimum(at[:, None] + width, len(data) - 1)]
            rows[width >= np.minimum(size, offsets[doc[part] + 1] - at)[:, None]] = 0
            out[part] = (signatures(rows, size, int(tables)) == own.signature[which[part], :tables]).any(1)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, recall: float = RECALL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` without any item. A decision holds for one id (or none) with one text, so other texts of the id stay."""
    own = F.struct(F.col(key).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("text"))
    rows = docs.select(own.alias("__row"), F.col(text).alias("__text"))
    bad = matches(rows, benchmark.withColumnRenamed(text, "__text"), share, recall, "__text", "__row").select("__row").distinct()
    same = own["id"].eqNullSafe(F.col("__row.id")) & (own["text"] == F.col("__row.text"))
    return docs.join(bad, same, "left_anti")
