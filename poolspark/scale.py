"""Ordered operators that never sort a whole group in one task.

Pools live on a handful of types, so a window partitioned by type alone would push a third of the
rows or more through one task. The helpers below split the ordering key into buckets of a fixed
width, run the window inside each bucket, and carry only one summary row per bucket upwards; the
summaries are split again until ``levels`` is exhausted. With unique keys a bucket holds at most
``width`` rows, so the task size is bounded by a parameter and not by the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolspark.session import cut_lineage

# A bucket holds at most a million rows; 10^12 keys leave a million bucket rows for the last window.
WIDTH = 1 << 20
LEVELS = 1


def _bucket(key: Column, width: int) -> Column:
    return F.floor(key / F.lit(width)).cast("long")


def growing_frames(group: Sequence[str], key: str):
    """Frames over the rows strictly before and strictly after, both growing from their start.

    The second one runs in descending order: a frame that ends at the last row is evaluated anew for
    every row, a growing one only adds to its state.
    """
    def frame(order):
        return Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    return frame(F.col(key).asc()), frame(F.col(key).desc())


def neighbours(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    carried: Mapping[str, Column],
    *,
    width: int = WIDTH,
    levels: int = LEVELS,
) -> DataFrame:
    """Nearest non-null ``carried`` values strictly before and after each row in key order.

    Adds ``prev_<name>`` and ``next_<name>`` for every entry. Equivalent to
    ``last/first(ignoreNulls)`` over the whole group, evaluated bucket by bucket.
    """
    names = list(carried)
    staged = df.select("*", *[carried[n].alias(f"__{n}") for n in names])
    return _neighbours(staged, list(group), key, names, width, levels).drop(*[f"__{n}" for n in names])


def _neighbours(df, group, key, names, width, levels):
    if levels <= 0:
        before, after = growing_frames(group, key)
        return df.select(
            "*",
            *[F.last(f"__{n}", ignorenulls=True).over(before).alias(f"prev_{n}") for n in names],
            *[F.last(f"__{n}", ignorenulls=True).over(after).alias(f"next_{n}") for n in names],
        )
    b = f"__b{levels}"
    bucketed = df.withColumn(b, _bucket(F.col(key), width))
    local = _neighbours(bucketed, [*group, b], key, names, width, 0)
    summary = bucketed.groupBy(*group, b).agg(
        *[F.max_by(F.when(F.col(f"__{n}").isNotNull(), F.col(f"__{n}")),
                   F.when(F.col(f"__{n}").isNotNull(), F.col(key))).alias(f"__{n}_last") for n in names],
        *[F.min_by(F.when(F.col(f"__{n}").isNotNull(), F.col(f"__{n}")),
                   F.when(F.col(f"__{n}").isNotNull(), F.col(key))).alias(f"__{n}_first") for n in names],
    )
    carried = [f"{n}_last" for n in names] + [f"{n}_first" for n in names]
    outer = _neighbours(summary, group, b, carried, width, levels - 1).select(
        *group, b,
        *[F.col(f"prev_{n}_last").alias(f"__up_prev_{n}") for n in names],
        *[F.col(f"next_{n}_first").alias(f"__up_next_{n}") for n in names],
    )
    joined = local.join(outer, [*group, b], "left")
    kept = [c for c in local.columns if c != b and c not in
            {f"prev_{n}" for n in names} | {f"next_{n}" for n in names}]
    return joined.select(
        *kept,
        *[F.coalesce(f"prev_{n}", f"__up_prev_{n}").alias(f"prev_{n}") for n in names],
        *[F.coalesce(f"next_{n}", f"__up_next_{n}").alias(f"next_{n}") for n in names],
    )


def running_total(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    value: str,
    out: str,
    *,
    width: int = WIDTH,
    levels: int = LEVELS,
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the strictly smaller keys of the group."""
    group = list(group)
    if levels <= 0:
        before = (Window.partitionBy(*group).orderBy(key)
                  .rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))
    b, inner, total, upper = (f"__{p}{levels}" for p in ("b", "in", "t", "up"))
    bucketed = df.withColumn(b, _bucket(F.col(key), width))
    local = running_total(bucketed, [*group, b], key, value, inner, levels=0)
    totals = bucketed.groupBy(*group, b).agg(F.sum(value).alias(total))
    outer = running_total(totals, group, b, total, upper, width=width, levels=levels - 1)
    return (local.join(outer.drop(total), [*group, b], "left")
            .withColumn(out, F.col(inner) + F.coalesce(upper, F.lit(0)))
            .drop(b, inner, upper))


def order_statistics(
    df: DataFrame,
    value: str,
    positions: Mapping[str, tuple[float, Column]],
    *,
    accuracy: int = 100_000,
    materialise: bool = True,
) -> DataFrame:
    """Exact elements of the ascending sort, without sorting the data.

    ``positions`` maps an output name to ``(fraction, index)``: ``index`` is a Column over ``n`` (the
    row count) giving the 0-based rank, ``fraction`` the share it sits at. A quantile sketch gives a
    bracket around the fraction, rows below it are only counted, and the exact rank is taken among
    the distinct values inside the bracket, about ``8 n / accuracy`` of them.
    ``materialise`` stores the one column first: it is read several times.
    """
    df = df.select(value)
    if materialise:
        df = cut_lineage(df)
    slack = 4.0 / accuracy
    names = list(positions)
    lows = [max(0.0, positions[n][0] - slack) for n in names]
    highs = [min(1.0, positions[n][0] + slack) for n in names]
    hist = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    sketch = df.agg(
        F.count(value).alias("n"),
        F.percentile_approx(value, lows, accuracy).alias("lo"),
        F.percentile_approx(value, highs, accuracy).alias("hi"),
    ).where("n > 0")
    # Scalar subquery: one row, a bounded array whatever the input size.
    marked = hist.withColumn("s", sketch.select(F.struct("n", "lo", "hi")).scalar())
    inside, below = [], []
    for i, n in enumerate(names):
        lo, hi = F.col("s.lo")[i], F.col("s.hi")[i]
        inside.append(F.when((F.col("v") >= lo) & (F.col("v") <= hi), F.lit(i)))
        below.append(F.sum(F.when(F.col("v") < lo, F.col("c")).otherwise(0)).alias(f"below_{i}"))
    counts = marked.agg(F.max("s.n").alias("n"), *below)
    bracket = (marked.select("v", "c", F.explode(F.array_compact(F.array(*inside))).alias("q")))
    upto = F.sum("c").over(Window.partitionBy("q").orderBy("v"))
    ranked = bracket.select("q", "v", "c", upto.alias("upto")).withColumn(
        "k", counts.select(F.struct(*counts.columns)).scalar()).select("q", "v", "c", "upto", "k.*")
    picks = []
    for i, n in enumerate(names):
        rank = positions[n][1] - F.col(f"below_{i}")
        hit = (F.col("q") == i) & (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
        picks.append(F.max(F.when(hit, F.col("v"))).alias(n))
    return ranked.agg(F.max("n").alias("n"), *picks)
