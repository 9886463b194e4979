"""Embedding whitening with distributed block matrices (``pyspark.mllib.linalg.distributed.BlockMatrix``).

Rows become whole numbers and are written once as blocks, each a run of at most ``block_rows`` rows of one task. The
blocks, centred, are a tall matrix; its transpose times itself is the scatter matrix, whose eigenvectors (dimensions x
dimensions, on the driver) give the whitening matrix. The blocks times that matrix are the whitened rows, and their own
scatter matrix shows how far their covariance is from the identity.

Two layouts of the same blocks keep every product spread over many tasks. For a scatter matrix all blocks stand below
each other and the product is cut along the rows into as many parts as there are blocks to a task. For the projection
the blocks stand in a square, times a matrix with the whitening matrix on its diagonal: the grid of a product is dealt to
tasks by rectangles, and a single column of blocks would go to the root of the tasks only.

Defined cases: rows whose vector is null, empty, or holds a null, a non-finite entry or one of more than 2^40 are left out; so
are rows of another length than the commonest one (ties: the longest); ids may be null or repeat, every row stays a row.
Components whose variance is within rounding of zero have ``whitened`` null and do not count for ``identity_error``;
``deviation`` is null beyond a long. An empty table, or one without a usable vector, gives no rows. Only the two named columns are
read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolspark.llm.store import shared_folder

COMPONENTS = 32
BLOCK_ENTRIES = 1 << 17  # numbers of a block: one megabyte
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 40)  # of an entry
_LONG = (1 << 63) - 1
_COLUMNS = ["part", "chunk", "dims", "rows", "ids", "x", "sums"]


def _blocks(vectors: DataFrame, block_entries: int) -> DataFrame:
    """One row per block: its task and number there, its ids, its whole numbers (row after row) and their sums."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        waiting: dict[int, list] = {}  # by length: ids and rows not written yet
        made: dict[int, int] = {}

        def block(dims: int, id_type) -> pa.RecordBatch:
            ids, rows = zip(*waiting.pop(dims))
            x = np.concatenate(rows)
            made[dims] = made.get(dims, 0) + 1
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([made[dims] - 1], pa.int32()), pa.array([dims], pa.int32()), pa.array([len(x)], pa.int32()),
                pa.array([pa.concat_arrays(ids)], pa.list_(id_type)), pa.array([x.tobytes()], pa.binary()), pa.array([x.sum(axis=0)], pa.list_(pa.int64()))], _COLUMNS)

        id_type = None
        for batch in batches:
            ids, column = batch.column("vec_id"), batch.column("vec")
            id_type = ids.type
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            # One run of rows of equal length at a time; a null counts as length 0.
            edges = np.concatenate([[0], np.flatnonzero(sizes[1:] != sizes[:-1]) + 1, [len(sizes)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                dims = int(sizes[lo]) if hi > lo else 0
                if not dims:
                    continue
                entries = column.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                fit = (np.abs(entries) <= LARGEST).all(axis=1)  # NaN is not
                x = np.floor(entries[fit] * float(SCALE)).astype(np.int64) + SHIFT
                own = ids.slice(lo, hi - lo).filter(pa.array(fit))
                limit, at = max(1, block_entries // dims), 0
                while at < len(x):
                    have = sum(len(r) for _, r in waiting.get(dims, []))
                    take = min(limit - have, len(x) - at)
                    waiting.setdefault(dims, []).append((own.slice(at, take), x[at:at + take]))
                    at += take
                    if have + take == limit:
                        yield block(dims, id_type)
            if len(waiting) > 64:  # many lengths: short blocks instead of a growing list
                for dims in list(waiting):
                    yield block(dims, id_type)
        for dims in list(waiting):
            yield block(dims, id_type)

    return vectors.mapInArrow(run, f"part int, chunk int, dims int, rows int, ids array<{kind}>, x binary, sums array<bigint>")


def _matrix(table: DataFrame, shape: tuple[int, int, int], place, cells) -> BlockMatrix:
    """A block matrix of the rows of ``table``: ``place(block)`` is where a block stands, ``cells(row)`` its numbers.

    ``shape``: rows and columns of a block, and the blocks along a side that the places fit in. Short blocks are filled up
    with zero rows, which add nothing to a product.
    """
    rows, cols, _ = shape

    def dense(row):
        x = cells(row)
        if len(x) < rows:
            x = np.vstack([x, np.zeros((rows - len(x), cols))])
        return place(row["block"]), DenseMatrix(rows, cols, np.asfortranarray(x).ravel(order="F"))

    return BlockMatrix(table.rdd.map(dense), rows, cols)


def _scatter(tall: BlockMatrix, splits: int) -> np.ndarray:
    """Transpose times the matrix itself, on the driver: columns x columns. The product runs in ``splits`` parts along the rows."""
    flat = tall.transpose()
    product = flat._java_matrix_wrapper.call("multiply", tall._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, flat.rowsPerBlock, tall.colsPerBlock).toLocalMatrix().toArray()


def _numbered(table: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``block``: blocks counted through all tasks. One number per task reaches the driver."""
    counts = dict(table.groupBy("part").agg(F.max("chunk")).collect())
    first, n = {}, 0
    for part in sorted(counts):
        first[part], n = n, n + counts[part] + 1
    at = F.create_map(*[F.lit(x) for p, f in first.items() for x in (p, f)])
    return table.withColumn("block", (F.element_at(at, F.col("part")) + F.col("chunk")).cast("int")), n


def _splits(blocks: int) -> int:
    """Parts of a product along the rows: up to 16 blocks each."""
    return max(1, -(-blocks // 16))


def whiten(vectors: DataFrame, components: int = COMPONENTS, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``) of ``vec_id``, ``vec``.

    One row for each usable vector and each of the first ``components`` components.
    """
    spark, folder = vectors.sparkSession, shared_folder(vectors.sparkSession, "whiten")
    id_kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    _blocks(vectors.select("vec_id", F.col("vec").cast("array<double>").alias("vec")), block_entries).write.parquet(f"file://{folder}/blocks")
    written = spark.read.parquet(f"file://{folder}/blocks")
    common = written.groupBy("dims").agg(F.sum("rows").alias("n")).orderBy(F.col("n").desc(), F.col("dims").desc()).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims, n = common["dims"], common["n"]
    table, blocks = _numbered(written.where(F.col("dims") == dims))
    sums = dict(table.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect())
    total = np.array([sums[i] for i in range(dims)], np.int64)
    block_rows = max(1, block_entries // dims)
    mean, rest = total // n, total % n  # the mean is mean + rest / n

    def centred(row):
        x = np.frombuffer(row["x"], np.int64).reshape(-1, dims)
        return (x - mean) - rest / n

    narrow = table.select("block", "x")
    level = StorageLevel.MEMORY_AND_DISK
    tall = _matrix(narrow, (block_rows, dims, blocks), lambda b: (b, 0), centred).persist(level)
    covariance = _scatter(tall, _splits(blocks)) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, dims)
    trace = float(np.trace(covariance))
    real = values[:k] > max(values[0], 0.0) * dims * 1e-15
    if not values[0] > 0:
        real[:] = False
    white = np.where(real, axes[:, :k] / np.sqrt(np.where(real, values[:k], 1.0)), 0.0)
    explained = (values[:k] / trace if trace > 0 else np.zeros(k)).tolist()

    # The blocks in a square, times a matrix with ``white`` on its diagonal.
    side = int(np.ceil(np.sqrt(blocks)))
    square = _matrix(narrow, (block_rows, dims, side), lambda b: (b // side, b % side), centred)
    diagonal = spark.sparkContext.parallelize(range(side), min(side, 64)).map(lambda i: ((i, i), DenseMatrix(dims, k, white.ravel(order="F"))))
    projected = square.multiply(BlockMatrix(diagonal, dims, k))
    flat = projected.blocks.map(lambda b: (int(b[0][0]) * side + int(b[0][1]), bytearray(np.ascontiguousarray(b[1].toArray()).tobytes())))
    spark.createDataFrame(flat, "block int, w binary").write.parquet(f"file://{folder}/whitened")
    tall.blocks.unpersist()
    white_rows = spark.read.parquet(f"file://{folder}/whitened")
    lengths = table.select("block", "rows")
    white_rows = white_rows.join(lengths, "block")

    def cells(row):
        return np.frombuffer(row["w"], np.float64).reshape(-1, k)[:row["rows"]]

    def block_sums(batches):
        for batch in batches:
            for w, rows in zip(batch.column("w"), batch.column("rows").to_pylist()):
                yield pa.RecordBatch.from_pydict({"s": [cells({"w": w.as_py(), "rows": rows}).sum(axis=0)]})

    moved = white_rows.select("w", "rows").mapInArrow(block_sums, "s array<double>").select(F.posexplode("s"))
    means = dict(moved.groupBy("pos").agg(F.sum("col")).collect())
    white_mean = np.array([means[i] for i in range(k)]) / n
    tall = _matrix(white_rows, (block_rows, k, blocks), lambda b: (b, 0), lambda row: cells(row) - white_mean).persist(level)
    found = _scatter(tall, _splits(blocks)) / n
    tall.blocks.unpersist()
    error = float(np.abs((found - np.eye(k))[np.ix_(real, real)]).max(initial=0.0))

    def rows_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, w = batch.column("ids")[i].values, batch.column("x")[i].as_py(), batch.column("w")[i].as_py()
                m = len(ids)
                whole = np.frombuffer(x, np.int64).reshape(-1, dims)
                white = np.frombuffer(w, np.float64).reshape(-1, k)[:m]
                away = _deviations(whole, total, n)
                for lo in range(0, m, 1024):  # short batches, whatever the block
                    hi = min(lo + 1024, m)
                    count = (hi - lo) * k
                    yield pa.RecordBatch.from_arrays([
                        ids.slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), hi - lo)), pa.array(np.full(count, n, np.int64)),
                        pa.array([a for a in away[lo:hi] for _ in range(k)], pa.int64()),
                        pa.array(white[lo:hi].ravel(), mask=np.tile(~real, hi - lo)), pa.array(np.tile(explained, hi - lo)),
                        pa.array(np.full(count, error))], [f.split()[0] for f in schema.split(", ")])

    return table.select("block", "ids", "x").join(white_rows.select("block", "w"), "block").select("ids", "x", "w").mapInArrow(rows_out, schema)


def _deviations(whole: np.ndarray, total: np.ndarray, n: int) -> list:
    """Sum over the dimensions of (n x - S)^2 of each row, exact; None beyond a long."""
    mean, rest = total // n, total % n
    close = whole - mean  # n x - S = n (x - mean) - rest
    most = float(np.abs(close).max(initial=0)) + 1.0
    if (most * n) ** 2 * whole.shape[1] < 2.0**62:
        away = close * n - rest
        return (away * away).sum(axis=1).tolist()
    exact = [sum((int(c) * n - int(r)) ** 2 for c, r in zip(row, rest)) for row in close]
    return [x if x <= _LONG else None for x in exact]
