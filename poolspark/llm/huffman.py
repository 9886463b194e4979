"""Token ids as canonical, length-limited Huffman codes in files of independent blocks (operator 6).

``write`` makes one file per range of document ids, so that file after file, document after document,
the ids stand in ascending order of document id. ``read`` gives them back.

A file: 8 bytes of magic; the code bits, each document on a byte boundary; then the index (document ids
and which of them are null, token counts, byte offsets, and the bit offset of every block of 256 ids
within its document); then the size of the index in 8 bytes. Code lengths are at most 16 bits and are
all that ``code.npy`` holds: the codes follow from them. A block is decoded without its neighbours, and
all blocks of a group are decoded side by side through one table of 2^16 entries.

Counts cover all ids of all texts. Texts are encoded once, into a compressed table of plain ids in the
shared folder; it is read to count and to write, and then deleted. Only Huffman bits are shuffled.

Defined results: a null or empty text has the end id alone; rows of equal document id stand in the order
of their bits; a null document id comes first; an empty table gives an empty folder and no rows. Only the
key and text columns are read, so other columns do not matter.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolspark.llm import store
from poolspark.llm import words as W
from poolspark.llm.units import UnitCache, cut_units, per_text

MAX_BITS = 16
BLOCK = 256
MAGIC = b"HUFIDS01"
_GROUP = 1 << 20  # ids decoded at once
_CACHES: dict[str, UnitCache] = {}


def tokenizer_cache(path: str) -> UnitCache:
    """The worker's cache for a tokenizer file."""
    if path not in _CACHES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are shared out by Spark
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)

        def encode(units: list[bytes]):
            out = own.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)
            ids = [e.ids for e in out]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((i for x in ids for i in x), np.int32, int(size.sum())), size

        _CACHES[path] = UnitCache(encode)
    return _CACHES[path]


def encoded(batch: pa.RecordBatch, text: str, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, ids per text), each text closed by ``end_id``."""
    data, offsets = W.texts(batch.column(text))
    start, end, doc = cut_units(data, offsets, W.SPACE)
    ids, each = tokenizer_cache(path).ids(data, start, end)
    size = per_text(each, doc, batch.num_rows) + 1
    out = np.full(len(ids) + batch.num_rows, end_id, np.int32)
    body = np.ones(len(out), bool)
    body[np.cumsum(size) - 1] = False
    out[body] = ids
    return out, size


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit in {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    merged, levels, is_leaf = leaves, [], np.ones(len(leaves), bool)
    for _ in range(limit):
        levels.append(is_leaf)
        pairs = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        merged, is_leaf = both[order], order < len(leaves)
    take, length = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    out[used] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each id: ascending by (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i], last = code, n
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for every value of the next 16 bits."""
    ids, size = np.zeros(1 << MAX_BITS, np.int32), np.ones(1 << MAX_BITS, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    reps = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    n = int(reps.sum())
    ids[:n], size[:n] = np.repeat(order, reps), np.repeat(lengths[order], reps)
    return ids, size


def pack_bits(ids: np.ndarray, size: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
    """(bytes, byte offset of each text, bit offset within its text of each block, blocks per text)."""
    n = lengths[ids].astype(np.int64)
    stop = np.cumsum(n)
    last = np.cumsum(size)
    first = last - size
    bits = stop[last - 1] - np.where(first > 0, stop[first - 1], 0)
    room = (bits + 7) // 8
    byte_at = np.cumsum(room) - room
    within = stop - n - np.repeat(np.where(first > 0, stop[first - 1], 0), size)
    at = within + 8 * np.repeat(byte_at, size)
    # Each code falls into at most two 32-bit words; the bits of a word never overlap, so their sum is their union.
    word, shift = at >> 5, 64 - (at & 31) - n
    value = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    total = int(byte_at[-1] + room[-1])
    out = np.zeros(total // 4 + 3, np.uint64)
    head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[head]] += np.add.reduceat(value >> np.uint64(32), head)
    out[word[head] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), head)
    blocks = (size + BLOCK - 1) // BLOCK
    edge = np.cumsum(blocks) - blocks
    block_at = np.repeat(first - BLOCK * edge, blocks) + BLOCK * np.arange(int(blocks.sum()))
    return out.astype(">u4").view(np.uint8)[:total], np.append(byte_at, total), within[block_at].astype(np.uint32), blocks


def unpack_bits(data: np.ndarray, bit: np.ndarray, n: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of blocks that begin at the given bits and hold ``n`` ids each, one block after the other."""
    order = np.argsort(-n, kind="stable")
    bit, left = bit[order].astype(np.int64), n[order]
    out_at = (np.cumsum(n) - n)[order]
    out = np.empty(int(n.sum()), np.int32)
    ids, size = table
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    for step in range(int(left[0]) if len(left) else 0):
        k = int(np.searchsorted(-left, -step, "left"))  # blocks with more than ``step`` ids
        at = bit[:k]
        byte = at >> 3
        window = (data[byte].astype(np.int64) << 16) | (data[byte + 1].astype(np.int64) << 8) | data[byte + 2]
        window = (window >> (8 - (at & 7))) & 0xFFFF
        out[out_at[:k] + step] = ids[window]
        bit[:k] = at + size[window]
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, vocabulary: int = 1 << 16, text: str = "text", key: str = "doc_id") -> int:
    """Encode all texts into files below ``path``; returns the number of files."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    plain = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "t"):
            ids, size = encoded(batch, "t", tokenizer, end_id)
            raw, edge = ids.astype(plain).tobytes(), plain.itemsize * np.append(0, np.cumsum(size))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([raw[a:b] for a, b in zip(edge[:-1], edge[1:])], pa.binary())], ["k", "ids"])

    table = os.path.join(path, "plain")
    source.mapInArrow(encode, "k long, ids binary").write.option("compression", "zstd").parquet(f"file://{table}")
    stored = spark.read.parquet(f"file://{table}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(W.texts(batch.column("ids"))[0].view(plain), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    # At most one row per id of the vocabulary comes back.
    rows = stored.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in rows:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    store.save(os.path.join(path, "code.npy"), lengths)
    cuts = stored.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0] if parts > 1 else []
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "ids"):
            raw, edge = W.texts(batch.column("ids"))
            ids, size = raw.view(plain).astype(np.int64), np.diff(edge) // plain.itemsize
            data, byte_at, marks, blocks = pack_bits(ids, size, lengths, codes)
            raw, rooms = data.tobytes(), np.append(0, np.cumsum(blocks))
            k = batch.column("k")
            part = np.searchsorted(bounds, np.asarray(k.fill_null(-2**63)), "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), k, pa.array(size), pa.array([raw[a:b] for a, b in zip(byte_at[:-1], byte_at[1:])], pa.binary()),
                 pa.array([marks[a:b].tobytes() for a, b in zip(rooms[:-1], rooms[1:])], pa.binary())], ["part", "k", "n", "bits", "marks"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, null, size, room, marks = None, [], [], [], [], []
        for batch in batches:
            if own is None:
                part = batch.column("part")[0].as_py()
                own = os.path.join(path, f"part-{part:06d}.{uuid.uuid4().hex}")
                out = open(own, "wb")
                out.write(MAGIC)
            bits, edge = W.texts(batch.column("bits"))
            out.write(bits)
            ids.append(np.asarray(batch.column("k").fill_null(0)))
            null.append(np.asarray(batch.column("k").is_null()))
            size.append(np.asarray(batch.column("n")))
            room.append(np.diff(edge))
            marks.append(W.texts(batch.column("marks"))[0].view(np.uint32))
        if own is not None:
            index = store.pack([np.concatenate(x) for x in (ids, [n.astype(np.uint8) for n in null], size, room, marks)])
            out.write(index + len(index).to_bytes(8, "little"))
            out.close()
            os.replace(own, os.path.join(path, f"part-{part:06d}.huf"))
            n = int(sum(x.sum() for x in size))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n])], ["part", "n"])

    dealt = (stored.mapInArrow(squeeze, "part int, k long, n long, bits binary, marks binary").repartitionById(len(bounds) + 1, "part")
             .sortWithinPartitions("k", "bits"))
    done = dealt.mapInArrow(save, "part int, n long").collect()  # one row per file
    shutil.rmtree(table)
    total = {r.part: r.n for r in done}
    order = np.array(sorted(total), np.int64)
    store.save(os.path.join(path, "parts.npy"), order)
    store.save(os.path.join(path, "starts.npy"), np.cumsum([0, *[total[p] for p in order]]))
    return len(order)


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row per document of a folder: its id, ``start``, ``n_tokens`` and ``ids`` (little-endian 32-bit)."""
    order, starts = np.load(os.path.join(path, "parts.npy")), np.load(os.path.join(path, "starts.npy"))
    schema = f"`{key}` long, start long, n_tokens long, ids binary"
    if not len(order):
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(np.load(os.path.join(path, "code.npy")))
        for batch in batches:
            for i in batch.column("id").to_pylist():
                yield from _documents(os.path.join(path, f"part-{order[i]:06d}.huf"), int(starts[i]), table, key)

    return spark.range(0, len(order), 1, len(order)).mapInArrow(run, schema)


def _documents(path: str, start: int, table, key: str) -> Iterator[pa.RecordBatch]:
    raw = np.memmap(path, np.uint8, "r")
    n = int(raw[-8:].view(np.int64)[0])
    ids, null, size, room, marks = store.unpack(bytes(raw[-8 - n:-8]))
    begin = len(MAGIC) + np.cumsum(room) - room
    blocks = (size + BLOCK - 1) // BLOCK
    mark_at = np.append(0, np.cumsum(blocks))
    stop = np.cumsum(size)
    row = 0
    while row < len(ids):
        base = int(stop[row] - size[row])
        to = max(row + 1, int(np.searchsorted(stop, base + _GROUP, "right")))
        own = slice(row, to)
        lo, hi = int(begin[row]), int(begin[to - 1] + room[to - 1])
        each = blocks[own]
        bit = marks[mark_at[row]:mark_at[to]] + 8 * np.repeat(begin[own] - lo, each)
        full = np.full(int(each.sum()), BLOCK, np.int64)
        full[np.cumsum(each) - 1] = size[own] - BLOCK * (each - 1)
        tokens = unpack_bits(raw[lo:hi], bit, full, table).astype("<u4").tobytes()
        edge = 4 * (np.append(0, stop[own] - base))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[own], mask=null[own] > 0), pa.array(start + stop[own] - size[own]), pa.array(size[own]),
             pa.array([tokens[a:b] for a, b in zip(edge[:-1], edge[1:])], pa.binary())], [key, "start", "n_tokens", "ids"])
        row = to

