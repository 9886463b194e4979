"""Bootstrap intervals.

Two forms with the same contract (low <= mean <= high, zero variance collapses the interval):

* ``resample``: every replicate draws exactly n rows with replacement, found by row index. The draws are made and
  looked up inside the tasks, a block of the values and a share of the replicates each: rows are moved once a share, never
  once a replicate. The work is replicates x n draws for every block of ``BLOCK`` rows.
* ``poisson``: every row weighs in each replicate with a Poisson(1) count. One pass, no join and no
  row number; only partial sums per replicate are shuffled, so it is the form for large tables.

Draws come from an integer mixing function, so a run is reproducible whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolspark.scale import running_total
from poolspark.session import cut_lineage

SEED = 1789
BACKTEST_REPLICATES = 3000
ANALYSIS_REPLICATES = 4000
MODULUS = 2147483629
BLOCK, PIECE, SHARE = 1 << 21, 1 << 15, 125  # rows looked up in one task, rows in one packed row, replicates of one task
_ROWS, _CELLS = 1024, 1 << 15  # rows, and numbers, that a task draws for at once: they stay in its cache


def mixed(replicate: Column, row: Column, seed: int = SEED) -> Column:
    """Integer hash below ``MODULUS`` of a replicate and a row; products stay under 2^62."""
    m = F.lit(MODULUS).cast("long")
    a = (replicate.cast("long") * 40503 + (row % m) * 9973 + seed) % m
    c = (a * a + 7) % m
    return (c * c + 3) % m


def poisson_limits(terms: int = 13) -> list[int]:
    """Integer thresholds of the Poisson(1) distribution function on ``0..MODULUS``."""
    import math

    total, limits = 0.0, []
    for k in range(terms):
        total += math.exp(-1.0) / math.factorial(k)
        limits.append(int(total * MODULUS))
    return limits


def poisson_weight(u: Column) -> Column:
    weight = F.lit(0)
    for limit in poisson_limits():
        weight = weight + F.when(u >= limit, 1).otherwise(0)
    return weight


def replicate_means(df: DataFrame, values: Sequence[str], row: str, replicates: int, *,
                    method: str = "resample", seed: int = SEED) -> DataFrame:
    """``b`` and one mean per value column and replicate. ``row`` is a unique integer row key."""
    if method == "poisson":
        return _poisson_means(df, list(values), row, replicates, seed)
    if method != "resample":
        raise ValueError(f"unknown bootstrap method {method}")
    return _resampled_means(df, list(values), row, replicates, seed)


def _remainder(x: np.ndarray, n: int) -> np.ndarray:
    """``x % n`` of numbers from 0 on; numpy divides by one number faster than it takes a remainder."""
    return x - x // n * n


def _drawn_sums(low: int, held: Sequence[np.ndarray], n: int, replicates: range, seed: int) -> Iterator[tuple[int, list[float]]]:
    """(replicate, sum per column of ``held``) over the draws that fall on rows ``low`` and following of ``n``."""
    size, totals = len(held[0]), np.zeros((len(replicates), len(held)))
    for at in range(0, n, PIECE):
        base = np.arange(at, min(at + PIECE, n), dtype=np.int64) % MODULUS * 9973 + seed
        for i, b in enumerate(replicates):
            a = _remainder(base + b * 40503, MODULUS)
            c = _remainder(a * a + 7, MODULUS)
            drawn = _remainder(_remainder(c * c + 3, MODULUS), n)
            if size < n:
                drawn = drawn - low
                drawn = drawn[(drawn >= 0) & (drawn < size)]
            totals[i] += [column[drawn].sum() for column in held]
    return zip(replicates, totals.tolist())


def _resampled_means(df: DataFrame, values: list[str], row: str, replicates: int, seed: int) -> DataFrame:
    df = cut_lineage(df.select(*[F.col(v).cast("double").alias(v) for v in values], row))
    indexed = running_total(df.withColumn("__one", F.lit(1)), [], row, "__one", "ix")
    n = df.agg(F.count("*")).scalar()
    pieces = indexed.groupBy(F.floor(F.col("ix") / PIECE).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("ix", *values))).alias("rows"))
    shares = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // SHARE))).alias("share")
    packed = pieces.select(F.floor(F.col("piece") * PIECE / BLOCK).alias("block"), "piece", n.alias("n"),
                           *[F.col("rows").getField(v).alias(f"v{i}") for i, v in enumerate(values)]).select("*", shares)

    def draw(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        low, n = table.column("piece")[0].as_py() * PIECE, table.column("n")[0].as_py()
        own = range(key[1].as_py() * SHARE, min(replicates, (key[1].as_py() + 1) * SHARE))
        held = []
        for i in range(len(values)):
            column = pa.chunked_array([c.flatten() for c in table.column(f"v{i}").chunks], pa.float64())
            held += [column.fill_null(0.0).to_numpy(), column.is_valid().to_numpy().astype(np.float64)]
        rows = list(_drawn_sums(low, held, n, own, seed))
        return pa.table({"b": pa.array([b for b, _ in rows], pa.int32()), **{
            name: pa.array([t[k] for _, t in rows], pa.float64()) for k, name in enumerate(names)}})

    names = [f"{part}{i}" for i in range(len(values)) for part in ("s", "n")]
    sums = packed.groupBy("block", "share").applyInArrow(draw, "b int, " + ", ".join(f"{x} double" for x in names))
    return sums.groupBy("b").agg(*[F.try_divide(F.sum(f"s{i}"), F.sum(f"n{i}")).alias(v) for i, v in enumerate(values)])


def _weights(rows: np.ndarray, replicates: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first replicate, weights of replicates x rows): the draws of ``mixed`` and ``poisson_weight``, some replicates at a time."""
    limits = poisson_limits()
    step = max(1, _CELLS // max(1, len(rows)))
    base = rows % MODULUS * 9973 + seed
    for first in range(0, replicates, step):
        b = np.arange(first, min(first + step, replicates), dtype=np.int64)
        a = (b[:, None] * 40503 + base) % MODULUS
        c = (a * a + 7) % MODULUS
        u = (c * c + 3) % MODULUS
        w = np.zeros(u.shape, np.int8)
        for limit in limits:
            w += u >= limit
        yield first, w


def _poisson_means(df: DataFrame, values: list[str], row: str, replicates: int, seed: int) -> DataFrame:
    """A partial aggregate: every task adds up its rows in one vector per value and hands on ``replicates`` rows, whatever it read."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn, sums, some = np.zeros(replicates), np.zeros((len(values), replicates)), False
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                keys = part.column(row).to_numpy(zero_copy_only=False).astype(np.int64)
                held = np.nan_to_num(np.array([part.column(v).to_numpy(zero_copy_only=False) for v in values], np.float64))
                some = some or len(keys) > 0
                for first, w in _weights(keys, replicates, seed):
                    own = slice(first, first + len(w))
                    drawn[own] += w.sum(axis=1, dtype=np.int64)
                    sums[:, own] += held @ w.T.astype(np.float64)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array(drawn), *map(pa.array, sums)],
                                             ["b", "drawn", *[f"s{i}" for i in range(len(values))]])

    rows = df.where(F.col(row).isNotNull()).select(F.col(row).cast("long").alias(row), *[F.col(v).cast("double").alias(v) for v in values])
    # Every row is weighed ``replicates`` times: the few input bytes are spread over every core.
    rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism, row)
    fields = "".join(f", s{i} double" for i in range(len(values)))
    partial = rows.mapInArrow(add, f"b int, drawn double{fields}")
    return partial.groupBy("b").agg(F.sum("drawn").alias("drawn"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(values))]).select(
        "b", *[F.try_divide(f"s{i}", "drawn").alias(v) for i, v in enumerate(values)])


def bootstrap_interval(df: DataFrame, values: Sequence[str], row: str, replicates: int, *,
                       method: str = "resample", seed: int = SEED, level: float = 0.95) -> DataFrame:
    """``name, low, high`` per value column: elements of the sorted replicate means."""
    tail = (1 - level) / 2
    low, high = int(tail * replicates), int((1 - tail) * replicates)
    means = replicate_means(df, values, row, replicates, method=method, seed=seed)
    long = means.select(F.explode(F.array(*[
        F.struct(F.lit(v).alias("name"), F.col(v).alias("mean")) for v in values])).alias("s")).select("s.*")
    # At most ``replicates`` rows per name.
    rank = F.row_number().over(Window.partitionBy("name").orderBy("mean")) - 1
    return (long.withColumn("i", rank).groupBy("name").agg(
        F.max(F.when(F.col("i") == low, F.col("mean"))).alias("low"),
        F.max(F.when(F.col("i") == min(high, replicates - 1), F.col("mean"))).alias("high")))


def head_trimmed(df: DataFrame, value: str, group: Sequence[str] = (), k: int = 3) -> DataFrame:
    """Sum without the ``k`` best rows over the full count; zero when there are no more than ``k``.

    The ranked filter is limited map-side, so only ``k`` rows per group and task are shuffled.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(value).desc()))
    head = (df.select(*group, value).withColumn("__r", rank).where(F.col("__r") <= k)
            .groupBy(*group).agg(F.sum(value).alias("__head")))
    totals = df.groupBy(*group).agg(F.sum(value).alias("__sum"), F.count(value).alias("n"))
    joined = totals.join(head, list(group), "left") if group else totals.withColumn(
        "__head", head.select("__head").scalar())
    trimmed = (F.col("__sum") - F.coalesce("__head", F.lit(0.0))) / F.col("n")
    return joined.select(*group, "n", F.when(F.col("n") <= k, F.lit(0.0)).otherwise(trimmed).alias("trimmed"))


def top_share_frame(df: DataFrame, value: str) -> DataFrame:
    """One row: ``n``, ``total``, ``largest`` and ``top_share`` of the best ``max(1, n // 100)`` rows."""
    from poolspark.scale import order_statistics

    n = F.col("n")
    df = cut_lineage(df.select(value))
    stats = order_statistics(df, value, {"edge": (0.99, n - F.floor(n / 100))}, materialise=False)
    edge_of = stats.select(F.struct("n", "edge")).scalar()
    marked = df.select(F.col(value).alias("v")).withColumn("s", edge_of)
    base = marked.agg(
        F.max("s.n").alias("n"), F.sum("v").alias("total"), F.max("v").alias("largest"), F.max("s.edge").alias("edge"),
        F.coalesce(F.sum(F.when(F.col("v") > F.col("s.edge"), F.col("v"))), F.lit(0.0)).alias("above"),
        F.count_if(F.col("v") > F.col("s.edge")).alias("n_above"))
    k = F.floor(n / 100)
    top = F.when(n < 100, F.col("largest")).otherwise(F.col("above") + (k - F.col("n_above")) * F.col("edge"))
    return base.select("n", "total", "largest",
                       F.when(F.col("total") != 0, top / F.col("total")).otherwise(F.lit(0.0)).alias("top_share"))


CELLS = 4096  # of a counting pass


def nth_key(df: DataFrame, key: str, rank: int) -> int:
    """The whole-number key at ascending 0-based ``rank``, by counting: each pass counts the keys per cell of the range that
    still holds it and goes on in one cell. At most six passes for 64 bits; a task hands on a row per cell."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    while low < high:
        width = -(-(high - low + 1) // CELLS)
        inside = df.where(F.col(key).between(low, high))
        cell = F.expr(f"cast((cast(`{key}` as decimal(38,0)) - ({low})) div cast({width} as decimal(38,0)) as int)")
        counts = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.orderBy("cell"))
        found = counts.withColumn("upto", upto).where(F.col("upto") > rank).orderBy("cell").first()
        rank -= found["upto"] - found["n"]
        low, high = low + found["cell"] * width, min(high, low + (found["cell"] + 1) * width - 1)
    return low


def split_half(df: DataFrame, day: str, key: str) -> DataFrame:
    """Adds ``half``: ``A`` for the first ``n // 2`` rows by (day, key), ``B`` for the others; rows without a day come first.

    Rows are counted per day, a table of one row a day, and the cut inside its day is found by counting keys.
    """
    upto = F.sum("n").over(Window.orderBy(F.col("d").asc_nulls_first()))
    days = df.groupBy(F.unix_date(F.col(day)).alias("d")).agg(F.count("*").alias("n")).withColumn("upto", upto)
    n = df.count()
    if n < 2:
        return df.withColumn("half", F.lit("B"))
    at = days.where(F.col("upto") > n // 2).orderBy("upto").first()
    of_day = F.unix_date(F.col(day)).eqNullSafe(F.lit(at["d"]).cast("int"))
    cut = nth_key(df.where(of_day), key, n // 2 - (at["upto"] - at["n"]))
    earlier = F.lit(False) if at["d"] is None else F.col(day).isNull() | (F.unix_date(F.col(day)) < at["d"])
    return df.withColumn("half", F.when(earlier | (of_day & (F.col(key) < cut)), "A").otherwise("B"))
