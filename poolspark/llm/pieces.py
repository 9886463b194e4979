"""SentencePiece encoding and decoding by suffix-array matching (operator 7).

The distinct units of a batch (a run of spaces and the word after it; no piece reaches from a word into
the next space) are put one after the other and indexed by a suffix array, sorted as deep as the longest
piece. Every piece of the model is binary-searched for its range of occurrences; the ranges give edges
(place, length, rank), which are sorted by place and relaxed:

* a BPE model joins, again and again, the two neighbouring symbols whose edge has the best score, the
  leftmost among equals, until no edge spans two neighbours;
* a unigram model takes the path with the best sum of scores.

What no piece covers becomes bytes (or the unknown id where the model has no bytes). Ids equal those of
the SentencePiece library. Models with a normaliser other than identity are refused.

Decoding gathers the bytes of the pieces; the space that encoding put in front is dropped.

Defined results: a null or empty text has no ids and decodes to an empty text; U+2581 decodes to a space,
as in the library; other columns stay, those named like the outputs are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from poolspark.llm import words as W
from poolspark.llm.units import UnitCache, cut_units, per_text

_SPACE_MARK = 0x2581
_GAP = W.byte_class(b" ")
_BLOCK = 250_000  # characters indexed at once
_PIECE = 1 << 20  # bytes of text encoded at once
_LONG = 256  # units of more characters are joined with a heap, one by one
_NONE = np.int32(2**31 - 1)
_MODELS: dict[str, "Model"] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message; bytes for nested ones."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, raw[at:at + n]
            at += n
        else:
            n = 8 if tag & 7 == 1 else 4
            yield tag >> 3, raw[at:at + n]
            at += n


class Model:
    """Pieces of a model file, ready for matching."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=path)
        spec = dict(_fields(own.serialized_model_proto()))
        trainer, normaliser = dict(_fields(spec.get(2, b""))), dict(_fields(spec.get(3, b"")))
        self.unigram = trainer.get(3, 1) == 1
        if trainer.get(3, 1) not in (1, 2) or normaliser.get(2, b"") or normaliser.get(4, 1):
            raise ValueError("only BPE and unigram models without text normalisation are supported")
        self.prefix = bool(normaliser.get(3, 1))
        n = own.get_piece_size()
        self.unknown = own.unk_id()
        self.bytes = np.full(256, -1, np.int32)
        surface, ids, scores = [], [], []
        self.surface = []
        for i in range(n):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif own.is_control(i):
                self.surface.append(b"")
            elif own.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.surface.append(piece.replace("▁", " ").encode())
                surface.append(piece)
                ids.append(i)
                scores.append(own.get_score(i))
        size = np.array([len(p) for p in surface])
        self.longest = int(size.max())
        self.char = np.zeros((len(surface), self.longest), np.int32)  # 0: past the end; characters are shifted by one
        for row, p in zip(self.char, surface):
            row[:len(p)] = np.frombuffer(p.encode("utf-32-le"), np.int32) + 1
        self.size, self.ids, self.score = size, np.array(ids, np.int32), np.array(scores, np.float64)
        # Rank 0 is the best score; equal scores share a rank. An id per (place, length) is kept beside it.
        self.rank = np.unique(-self.score, return_inverse=True)[1].astype(np.int32)
        self.piece_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self.piece_size = np.array([len(x) for x in self.surface], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.opens_with_space = np.array([x[:1] == b" " for x in self.surface])
        self.cache = UnitCache(self.encode_units)

    @staticmethod
    def load(path: str) -> "Model":
        if path not in _MODELS:
            _MODELS[path] = Model(path)
        return _MODELS[path]

    # Suffix array and matching.

    def _suffixes(self, text: np.ndarray) -> np.ndarray:
        """Places in the order of the suffixes, compared over the length of the longest piece."""
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        have = 1
        while True:
            nxt = np.zeros(len(text), np.int64)
            nxt[:-have] = rank[have:] + 1
            key = rank * (len(text) + 2) + nxt
            have *= 2
            if have >= self.longest:
                return np.argsort(key, kind="stable")
            rank = np.unique(key, return_inverse=True)[1]

    def _ranges(self, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every piece the range of ``order`` whose suffixes begin with it; narrowed character by character."""
        padded = np.concatenate([text, np.zeros(self.longest, text.dtype)])
        lo, hi = np.zeros(len(self.size), np.int64), np.full(len(self.size), len(order), np.int64)
        for k in range(self.longest):
            live = np.flatnonzero((self.size > k) & (lo < hi))
            want, column = self.char[live, k], padded[order + k]
            lo[live], hi[live] = (_bisect(column, want, lo[live], hi[live], strict) for strict in (False, True))
        return lo, hi

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of every occurrence of every piece, by place, then length."""
        order = self._suffixes(text)
        lo, hi = self._ranges(text, order)
        n = np.maximum(hi - lo, 0)
        piece = np.repeat(np.arange(len(n)), n)
        stop = np.cumsum(n)
        place = order[np.repeat(lo - (stop - n), n) + np.arange(int(stop[-1]))]
        by = np.argsort(place * (self.longest + 1) + self.size[piece], kind="stable")
        return place[by], self.size[piece][by], piece[by]

    # Encoding of distinct units.

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out, sizes, held, n = [], [], [], 0
        for u in units:
            held.append(u)
            n += len(u)
            if n >= _BLOCK:
                ids, size = self._encode_block(held)
                out.append(ids)
                sizes.append(size)
                held, n = [], 0
        if held:
            ids, size = self._encode_block(held)
            out.append(ids)
            sizes.append(size)
        return np.concatenate(out), np.concatenate(sizes)

    def _encode_block(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = [u.decode().replace(" ", "▁") for u in units]
        size = np.array([len(u) for u in whole], np.int64)
        text = np.zeros(int(size.sum()) + len(size), np.int32)  # a 0 after each unit: no piece holds it
        start = np.cumsum(size + 1) - size - 1
        text_at = np.ones(len(text), bool)
        text_at[start + size] = False
        text[text_at] = np.frombuffer("".join(whole).encode("utf-32-le"), np.int32) + 1
        place, length, piece = self.edges(text)
        found = np.full((len(text), self.longest + 1), -1, np.int32)
        found[place, length] = piece
        cut = self._best_paths(text, start, size, place, length, piece) if self.unigram else self._joined(start, size, found)
        # cut: places where a symbol begins, ascending; the symbol ends at the next one or at the end of its unit.
        unit = np.searchsorted(start, cut, "right") - 1
        ends = np.append(cut[1:], len(text))
        ends = np.minimum(ends, start[unit] + size[unit])
        got = np.where(ends - cut <= self.longest, found[cut, np.minimum(ends - cut, self.longest)], -1)
        ids = np.where(got >= 0, self.ids[got], -1)
        if (ids < 0).any():
            return self._with_bytes(text, cut, ends, unit, ids, len(units))
        return ids.astype(np.int32), np.bincount(unit, minlength=len(units))

    def _with_bytes(self, text, cut, ends, unit, ids, n):
        """Symbols without a piece as bytes, or as the unknown id."""
        out, owner = [], []
        for a, b, u, i in zip(cut.tolist(), ends.tolist(), unit.tolist(), ids.tolist()):
            if i >= 0:
                more = [i]
            elif self.bytes[0] >= 0:
                more = self.bytes[list((text[a:b] - 1).astype("<i4").tobytes().decode("utf-32-le").encode())].tolist()
            else:
                more = [self.unknown]
            out += more
            owner += [u] * len(more)
        return np.array(out, np.int32), np.bincount(owner, minlength=n)

    def _joined(self, start, size, found) -> np.ndarray:
        """BPE: where symbols begin once no two neighbours can be joined."""
        rank = np.where(found >= 0, self.rank[found], _NONE)
        long = size > _LONG
        done = [self._joined_one(int(a), int(n), rank) for a, n in zip(start[long], size[long])]
        begin = np.repeat(start[~long], size[~long]) + _ramp(size[~long])
        unit = np.repeat(np.arange(int((~long).sum())), size[~long])
        length = np.ones(len(begin), np.int64)
        while len(begin):
            same = np.append(unit[1:] == unit[:-1], False)
            both = length + np.append(length[1:], 0)
            fits = same & (both <= self.longest)
            r = np.full(len(begin), _NONE, np.int64)
            r[fits] = rank[begin[fits], both[fits]]
            key = r * len(begin) + np.arange(len(begin))  # best rank, then leftmost
            head = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.minimum.reduceat(key, head)
            can = best < int(_NONE) * len(begin)
            at = best[can] % len(begin)
            length[at] += length[at + 1]
            keep = np.ones(len(begin), bool)
            keep[at + 1] = False
            # Units in which nothing can be joined any more are finished.
            over = np.repeat(~can, np.diff(np.append(head, len(begin))))
            done.append(begin[over])
            keep &= ~over
            begin, unit, length = begin[keep], unit[keep], length[keep]
        return np.sort(np.concatenate(done)) if done else begin

    def _joined_one(self, start: int, n: int, rank) -> np.ndarray:
        """The same for one long unit, with a heap of the possible joins."""
        size, left, right = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(a):
            b = right[a]
            if b < n and size[a] + size[b] <= self.longest:
                r = int(rank[start + a, size[a] + size[b]])
                if r != _NONE:
                    heapq.heappush(heap, (r, a, size[a] + size[b]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, both = heapq.heappop(heap)
            b = right[a]
            if not size[a] or b >= n or size[a] + size[b] != both:
                continue
            size[a], size[b] = both, 0
            right[a] = right[b]
            if right[a] < n:
                left[right[a]] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
        return start + np.flatnonzero(size)

    def _best_paths(self, text, start, size, place, length, piece) -> np.ndarray:
        """Unigram: relax the edges in order of place; characters without a piece cost more than any piece."""
        poor = float(self.score.min()) - 10.0
        best = np.full(len(text) + 1, -np.inf)
        back = np.ones(len(text) + 1, np.int64)
        best[start] = 0.0
        edge = np.searchsorted(place, np.arange(len(text) + 1))
        stop = np.zeros(len(text) + 1, bool)
        stop[start + size] = True
        for at in range(len(text)):
            if stop[at]:
                continue
            steps = [(1, poor)] + [(int(length[e]), float(self.score[piece[e]])) for e in range(edge[at], edge[at + 1])]
            for n, s in steps:
                if best[at] + s > best[at + n] or (n > 1 and best[at] + s == best[at + n]):
                    best[at + n], back[at + n] = best[at] + s, n
        out = []
        for a, n in zip(start.tolist(), size.tolist()):
            at = a + n
            while at > a:
                at -= int(back[at])
                out.append(at)
        return np.sort(np.array(out, np.int64))

    # Whole texts.

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids per text)."""
        column = pc.replace_substring(pc.fill_null(column, ""), "▁", " ")
        if self.prefix:
            column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(" ", column, ""))
        data, offsets = W.texts(column)
        start, end, doc = cut_units(data, offsets, _GAP)
        ids, each = self.cache.ids(data, start, end)
        return ids, per_text(each, doc, len(column))

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[bytes]:
        n = self.piece_size[ids]
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(stop) else 0
        raw = self.piece_bytes[np.repeat(self.piece_at[ids] - (stop - n), n) + np.arange(total)].tobytes()
        last = np.cumsum(size)
        edge = np.append(0, np.append(0, stop)[last])
        lead = np.zeros(len(size), np.int64)
        some = size > 0
        if self.prefix:
            lead[some] = self.opens_with_space[ids[(last - size)[some]]]
        return [raw[a + s:b] for a, b, s in zip(edge[:-1].tolist(), edge[1:].tolist(), lead.tolist())]


def _ramp(size: np.ndarray) -> np.ndarray:
    stop = np.cumsum(size)
    return np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - size, size)


def _bisect(column, want, lo, hi, after: bool):
    """First place in each [lo, hi) whose value is not below (``after``: is above) the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) >> 1
        got = column[mid]
        up = got <= want[live] if after else got < want[live]
        lo[live[up]] = mid[up] + 1
        hi[live[~up]] = mid[~up]


def _schema(docs: DataFrame, drop: str, more: str) -> tuple[list[str], str]:
    kept = [c for c in docs.columns if c != drop]
    return kept, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + [more])


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of every text, as an array."""
    kept, schema = _schema(docs, out, f"`{out}` array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.load(model)
        for batch in W.pieces(batches, text, _PIECE):
            ids, size = own.encode(batch.column(text))
            rows = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], rows], [*kept, out])

    return docs.select(*kept).mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str, text: str = "text", out: str = "ids", back: str = "decoded") -> DataFrame:
    """Adds the ids of every text and the text they decode to, in one pass: one worker a task holds the model."""
    taken = [c for c in docs.columns if c not in (out, back)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*taken).schema] + [f"`{out}` array<int>", f"`{back}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.load(model)
        for batch in W.pieces(batches, text, _PIECE):
            ids, size = own.encode(batch.column(text))
            rows = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(ids.astype(np.int32)))
            raw = own.decode(ids, size)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in taken], rows, pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], [*taken, out, back])

    return docs.select(*taken).mapInArrow(run, schema)


def decode(docs: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of every array of ids; bytes that are not UTF-8 become U+FFFD."""
    kept, schema = _schema(docs, out, f"`{out}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.load(model)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                column = part.column(ids)
                size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
                raw = own.decode(np.asarray(pc.list_flatten(column)), size)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], [*kept, out])

    return docs.select(*kept).mapInArrow(run, schema)
