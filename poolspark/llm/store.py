"""Sorted hash arrays in the shared folder: written by the tasks of one job, memory-mapped by later ones.

A table is 2^bits shards; the top bits of a key name its shard. Keys reach the task that owns a shard
as blobs (one row per shard and flush), so a shuffle moves arrays, not rows. A file is written under a
name of its own and then renamed, so a task that runs again after a lost executor leaves the same file.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from poolspark.session import ensure_checkpoint_dir

U64 = np.uint64
FLUSH = 3 << 20  # keys gathered by a task before they are handed to the shuffle


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` that all executors see as files.

    Memory-mapping needs a file system that is mounted on every machine; another scheme is refused.
    """
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base.startswith("file:"):
        base = "/" + base[len("file:"):].lstrip("/")
    elif "://" in base:
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder here, not {base}")
    folder = os.path.join(base, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(folder)
    # Results read these files until the driver ends; nobody does after that.
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shard_bits(spark: SparkSession) -> int:
    """Shards follow the configured shuffle partitions, rounded up to a power of two."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()


def save(path: str, array: np.ndarray) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        np.save(out, array, allow_pickle=False)
    os.replace(own, path)


def shard_path(folder: str, table: str, shard: int, column: str) -> str:
    return os.path.join(folder, f"{table}.{shard}.{column}.npy")


class Table:
    """Read side: looks keys up in the mapped shards; pickles as its paths only."""

    def __init__(self, folder: str, name: str, bits: int, columns: tuple[str, ...] = ()):
        self.folder, self.name, self.bits, self.columns = folder, name, bits, columns
        self._open: dict = {}

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def _shard(self, shard: int) -> dict[str, np.ndarray]:
        if shard not in self._open:
            self._open[shard] = {c: _mapped(shard_path(self.folder, self.name, shard, c)) for c in ("key", *self.columns)}
        return self._open[shard]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(found, columns) for ascending ``keys``; what is not found has 0 in every column."""
        found = np.zeros(len(keys), bool)
        out: dict[str, np.ndarray] = {}
        # Ascending keys visit the shards in order, so each mapped file is read front to back.
        edge = np.searchsorted(keys >> U64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U64))
        for shard in np.flatnonzero(edge[1:] > edge[:-1]):
            lo, hi = edge[shard], edge[shard + 1]
            have = self._shard(int(shard))
            stored = have["key"]
            if not len(stored):
                continue
            at = np.minimum(np.searchsorted(stored, keys[lo:hi]), len(stored) - 1)
            hit = stored[at] == keys[lo:hi]
            found[lo:hi] = hit
            for c in self.columns:
                if c not in out:
                    out[c] = np.zeros(len(keys), have[c].dtype)
                out[c][lo:hi][hit] = have[c][at[hit]]
        for c in self.columns:
            out.setdefault(c, np.zeros(len(keys), np.int64))
        return found, out

    def match(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """As ``find`` for keys in any order, with repeats."""
        distinct, back = np.unique(keys, return_inverse=True)
        found, out = self.find(distinct)
        return found[back], {c: v[back] for c, v in out.items()}


def _mapped(path: str) -> np.ndarray:
    whole = np.load(path, allow_pickle=False) if os.path.getsize(path) < 4096 else np.load(path, mmap_mode="r")
    return whole.view(np.ndarray)


BLOBS = "shard int, part int, blob binary"


def blob_rows(shards: np.ndarray, arrays: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """One row per shard that has keys: its slice of each array, one after the other. ``shards`` ascend."""
    edge = np.searchsorted(shards, np.arange((1 << bits) + 1))
    some = np.flatnonzero(edge[1:] > edge[:-1])
    rows = [pack([a[edge[s]:edge[s + 1]] for a in arrays]) for s in some]
    return pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), len(arrays), np.int32)), pa.array(rows, pa.binary())],
        ["shard", "part", "blob"])


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of any numeric type in one blob."""
    head = np.array([len(arrays), *[x for a in arrays for x in (a.dtype.num, a.size)]], np.int64)
    return b"".join([head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * n, 8)
    out, at = [], 8 * (1 + 2 * n)
    for kind, size in head.reshape(-1, 2):
        dtype = _TYPES[int(kind)]
        out.append(np.frombuffer(blob, dtype, int(size), at))
        at += dtype.itemsize * int(size)
    return out


_TYPES = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.int8, np.uint16, np.int32, np.uint32, np.int64, np.uint64, np.float32, np.float64)}


def build(blobs: DataFrame, bits: int, write: Callable[[int, list[list[np.ndarray]]], list], schema: str) -> DataFrame:
    """Bring the blobs of each shard to one task and call ``write(shard, parts)`` there, also for an empty shard.

    ``write`` saves the shard's files and returns rows of ``schema``.
    """
    spark = blobs.sparkSession
    # Every shard gets a row, so that a shard without keys still gets its (empty) files.
    empty = spark.range(0, 1 << bits, 1, 1).selectExpr("cast(id as int) as shard", "0 as part", "cast(null as binary) as blob")
    dealt = blobs.unionByName(empty).repartitionById(1 << bits, "shard")
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob")):
                own = parts.setdefault(shard, [])
                if blob.is_valid:
                    own.append(unpack(blob.as_py()))
        for shard, own in parts.items():
            rows = write(shard, own)
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=arrow_schema(schema))

    return dealt.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(",")])


def stacked(parts: list[list[np.ndarray]], kinds: list) -> list[np.ndarray]:
    """Column-wise concatenation of the blobs of a shard."""
    if not parts:
        return [np.zeros(0, k) for k in kinds]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(kinds))]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sum of their counts (as int64)."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first)
