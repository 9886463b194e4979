"""Word kernel: cut Arrow text columns into words and hash them, without a Python object per word.

Inside a task a batch of texts is one byte buffer; words are (start, end) spans over it and every word
or run of words gets a 64-bit hash from prefix sums of a polynomial modulo 2^64. All helpers work on
whole texts of any length; ``pieces`` only bounds how much is held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 4 << 20  # bytes of text worked on at once; a longer single text is still taken whole
_BLOCK = 1 << 16  # bytes (or words) per prefix sum: stays in the cache
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64) | U64(1)


def byte_class(members: bytes) -> bytes:
    """A translation table: 1 for the members, 0 for all other bytes."""
    return bytes(int(c in members) for c in range(256))


def translated(data: np.ndarray, table: bytes, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(table), kind)


# The white space of the contracts: 0x20 and 0x09 to 0x0D.
SPACE = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
# Everything in ASCII that is neither a letter nor a digit; bytes from 0x80 on belong to letters.
PUNCTUATION = byte_class(bytes(c for c in range(128) if not chr(c).isalnum()))
# A-Z to a-z, all other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n, 1 << 16) + 1, base, U64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        ends = offsets_of(batch.column(column))[1:]
        row, base = 0, 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(row, stop - row)
            base, row = int(ends[stop - 1]), stop


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets of each text, from 0; a null counts as empty."""
    return _layout(column)[1]


def _layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if n == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]."""
    return _layout(column)


def spans(data: np.ndarray, offsets: np.ndarray, gap: bytes = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every maximal run of bytes outside ``gap`` within one text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~translated(data, gap, bool)
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[cuts] = word[cuts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[cuts] = word[cuts]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = _TABLE) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans ascend and do not overlap."""
    out = np.empty(len(start), U64)
    i, n = 0, len(start)
    while i < n:
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        if hi - lo > _BLOCK:  # one huge word: the same polynomial, block by block
            total = 0
            for at in range(lo, hi, _BLOCK):
                part = values[data[at:min(at + _BLOCK, hi)]]
                total += int((part * _powers(_BASE, len(part))[:len(part)]).sum(dtype=U64)) * pow(_BASE, at - lo, 1 << 64)
            out[i] = total % (1 << 64)
        else:
            sums = np.zeros(hi - lo + 1, U64)
            part = np.empty(hi - lo, U64)
            values.take(data[lo:hi], out=part, mode="clip")
            part *= _powers(_BASE, hi - lo)[:hi - lo]
            np.cumsum(part, out=sums[1:])
            a, b = start[i:j] - lo, end[i:j] - lo
            out[i:j] = (sums[b] - sums[a]) * _powers(_INVERSE, hi - lo)[a]
        i = j
    return mix(out ^ (end - start).astype(U64))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` successive word hashes; run i starts at word i."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    for lo in range(0, n, _BLOCK):
        hi = min(lo + _BLOCK, n)
        part = hashes[lo:hi + size - 1]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * _powers(_BASE, len(part))[:len(part)], out=sums[1:])
        out[lo:hi] = (sums[size:] - sums[:-size]) * _powers(_INVERSE, hi - lo)[:hi - lo]
    return mix(out ^ U64(size))


def within(doc: np.ndarray, size: int) -> np.ndarray:
    """Which runs of ``size`` words lie in one text."""
    return doc[:len(doc) - size + 1] == doc[size - 1:] if len(doc) >= size else np.zeros(0, bool)


def slide(values: np.ndarray, size: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or maximum) over each run of ``size`` values."""
    if len(values) < size:
        return values[:0]
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def join_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """Words of each of ``n`` texts joined by one space."""
    size = end - start + 1
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(start - (stop - size), size)
    out = data[np.minimum(at, max(len(data) - 1, 0))] if total else np.zeros(0, np.uint8)
    out[stop - 1] = 0x20
    per = np.zeros(n + 1, np.int64)
    np.add.at(per, doc + 1, size)
    edge = np.cumsum(per)
    drop = np.flatnonzero(per[1:])  # the space after the last word of a text
    keep = np.ones(total, bool)
    keep[edge[drop + 1] - 1] = False
    edge = edge - np.concatenate([[0], np.cumsum(per[1:] > 0)])
    buffer = pa.py_buffer(out[keep].tobytes())
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(edge.tobytes()), buffer).cast(pa.string())


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs."""
    return np.unique(keys, return_counts=True)
