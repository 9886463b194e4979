"""CRC-32 of many spans of one byte buffer at once, from tables by byte and distance from the end of the span.

CRC-32 is affine: the value of a message is the value of as many zero bytes, xor one contribution per byte that depends
only on the byte and on how many bytes follow it. With a table of contributions per distance, the values of all spans
are one lookup per byte and one ``bitwise_xor.reduceat`` over the spans; the values of zero bytes are a constant per
length. Spans longer than the table are folded block by block from the left: the register so far is moved past the
next block by four lookups, and the block adds its own contributions.
"""

from __future__ import annotations

import zlib

import numpy as np

DEPTH = 64  # distances in the table; also the bytes of a block of a long span
_PIECE = 1 << 18  # bytes of spans worked on at once
_POLYNOMIAL = 0xEDB88320  # fixed value: the reversed polynomial of CRC-32


def _by_byte() -> np.ndarray:
    """Register after one byte, from an empty register."""
    register = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        register = (register >> np.uint32(1)) ^ np.where(register & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return register


def _tables(depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contribution by distance and byte, register moved past ``depth`` zero bytes by its byte and value, value of n zero bytes)."""
    first = _by_byte()
    past = np.empty((depth, 256), np.uint32)
    past[0] = first
    for distance in range(1, depth):  # one more byte follows
        past[distance] = first[past[distance - 1] & np.uint32(0xFF)] ^ (past[distance - 1] >> np.uint32(8))
    moved = np.empty((4, 256), np.uint32)
    for byte in range(4):
        register = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
        for _ in range(depth):
            register = first[register & np.uint32(0xFF)] ^ (register >> np.uint32(8))
        moved[byte] = register
    return past, moved, np.array([zlib.crc32(bytes(n)) for n in range(depth + 1)], np.uint32)


_PAST, _MOVED, _ZEROS = _tables(DEPTH)
_FLAT = _PAST.ravel()


def span_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start[i]:end[i]]`` for every i, as unsigned 32-bit integers; spans may overlap and be empty."""
    size = end - start
    out = np.zeros(len(start), np.uint32)
    short = np.flatnonzero((size > 0) & (size <= DEPTH))
    total = np.cumsum(size[short])
    at = 0
    while at < len(short):  # bounded pieces: the work arrays hold several numbers per byte
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PIECE, "right")))
        own = short[at:stop]
        out[own] = _short(data, start[own], size[own])
        at = stop
    for i in np.flatnonzero(size > DEPTH):
        out[i] = _folded(data[start[i]:end[i]])
    return out


def _short(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    stop = np.cumsum(size)
    heads = stop - size
    # Every byte of every span, one span after the other, and its distance from the end of its span.
    place = np.arange(int(stop[-1]), dtype=np.int64)
    byte = data[place + np.repeat(start - heads, size)]
    distance = np.repeat(stop, size) - 1 - place
    return np.bitwise_xor.reduceat(_FLAT.take((distance << 8) + byte), heads) ^ _ZEROS[size]


def _folded(span: np.ndarray) -> int:
    """CRC-32 of one span of any length."""
    lead = len(span) % DEPTH or DEPTH
    falling = np.arange(DEPTH, dtype=np.int64)[::-1] << 8
    # The inverted start of the register is the same as four inverted bytes; the first block takes it through its constant.
    register = int(np.bitwise_xor.reduce(_FLAT[falling[DEPTH - lead:] + span[:lead]])) ^ int(_ZEROS[lead]) ^ 0xFFFFFFFF
    blocks = span[lead:].reshape(-1, DEPTH)
    own = np.bitwise_xor.reduce(_FLAT[falling + blocks], axis=1) if len(blocks) else np.zeros(0, np.uint32)
    m0, m1, m2, m3 = (m.tolist() for m in _MOVED)
    for value in own.tolist():
        register = m0[register & 255] ^ m1[register >> 8 & 255] ^ m2[register >> 16 & 255] ^ m3[register >> 24] ^ value
    return register ^ 0xFFFFFFFF
