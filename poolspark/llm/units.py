"""Encode each distinct unit of text once: a per-process cache from unit hashes to token ids.

A unit is a piece of text that an encoder treats on its own (white space and the word after it). Texts
repeat their units, so a task encodes the distinct ones and gathers the ids of all others from a pool.
The cache lives as long as the Python worker and is emptied when it holds ``limit`` units; that bounds
memory and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from poolspark.llm import words as W

U64 = np.uint64
Encoder = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


class UnitCache:
    def __init__(self, encode: Encoder, limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(0, U64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)
        self.used = 0

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after the other, how many each unit has)."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        distinct, sample, back = np.unique(W.span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.key) + len(distinct) > self.limit and len(self.key):
            self._clear()
        where = np.searchsorted(self.key, distinct)
        new = np.ones(len(distinct), bool)
        inside = where < len(self.key)
        new[inside] = self.key[where[inside]] != distinct[inside]
        if new.any():
            raw = data.tobytes()
            todo = sample[new]
            ids, size = self.encode([raw[a:b] for a, b in zip(start[todo].tolist(), end[todo].tolist())])
            if self.used + len(ids) > len(self.pool):
                grown = np.empty(max(2 * len(self.pool), self.used + len(ids)), np.int32)
                grown[:self.used] = self.pool[:self.used]
                self.pool = grown
            self.pool[self.used:self.used + len(ids)] = ids
            at = self.used + np.cumsum(size) - size
            self.used += len(ids)
            self.key = np.insert(self.key, where[new], distinct[new])
            self.at = np.insert(self.at, where[new], at)
            self.size = np.insert(self.size, where[new], size)
            where = np.searchsorted(self.key, distinct)
        each = self.size[where][back].astype(np.int64)
        from_pool = self.at[where][back]
        stop = np.cumsum(each)
        return self.pool[np.repeat(from_pool - (stop - each), each) + np.arange(stop[-1])], each


def cut_units(data: np.ndarray, offsets: np.ndarray, gap: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number): each text is cut in front of every ``gap`` byte that follows another byte.

    No cut is made after a white-space character outside ASCII: it may belong to the same run.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    blank = W.translated(data, gap, bool)
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first[0] = False
    at = np.flatnonzero(first)
    wide = at[data[at - 1] >= 0x80]
    if len(wide):
        c, b, a = (data[np.maximum(wide - k, 0)].astype(np.int64) for k in (1, 2, 3))
        space = ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))
                 | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
                 | (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
                 | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80))
        first[wide[space]] = False
    full = offsets[:-1] < offsets[1:]
    first[offsets[:-1][full]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(data))
    return start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))


def per_text(each: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Ids per text from ids per unit."""
    return np.bincount(doc, weights=each, minlength=n).astype(np.int64) if len(each) else np.zeros(n, np.int64)
