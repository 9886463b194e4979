"""Dating pools from their fixtures: anchors, chronology, admission, interpolation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolspark.operators.chronology import chronological
from poolspark.scale import LEVELS, WIDTH, neighbours
from poolspark.session import cut_lineage

# Agreeing fixtures of a sure and of a supplementary anchor, window in days.
SURE_FIXTURES = 3
EXTRA_FIXTURES = 2
WINDOW_DAYS = 3
MANUAL_WEIGHT = 99
TIGHT_DAYS = 3
CHUNK = 1 << 14  # pools of one group of the anchor search, by number
CELLS = 1 << 25  # matches x days that a task counts at once
# Where a date comes from.
BY_FIXTURES, INTERPOLATED, OUTSIDE = "affiches", "interpolation", "hors_ancrage"


def anchors(matches: DataFrame, fixtures: DataFrame, minimum: int, key: Sequence[str] = ("pool_type", "pool_id"),
            window: int = WINDOW_DAYS) -> DataFrame:
    """Best day per pool: most matches having a fixture within ``window`` days after it, earliest on ties.

    ``matches``: key (its last column a whole number), ord, home_key, away_key; ``fixtures``: home_key, away_key,
    match_date. Every pair of teams becomes one row with its calendar, a bit a day. Pools are taken in chunks of ``CHUNK``
    numbers, and a chunk gets the calendar of a pair once, however many of its matches that pair plays; days are counted there.
    """
    key = list(key)
    days = fixtures.where("match_date IS NOT NULL").groupBy("home_key", "away_key").agg(
        F.collect_set(F.unix_date("match_date")).alias("days"))
    calendars = days.mapInArrow(_packed, "home_key string, away_key string, first int, bits binary")
    rows = matches.select(*key, "ord", "home_key", "away_key", F.floor(F.col(key[-1]) / CHUNK).alias("chunk"))
    pairs = rows.select(*[F.col(c).alias(c) for c in ("chunk", "home_key", "away_key")]).distinct()
    wanted = pairs.join(calendars, ["home_key", "away_key"])
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def best(own: pa.Table, known: pa.Table) -> pa.Table:
        known = known.append_column("at", pa.array(np.arange(known.num_rows)))
        met = own.join(known.select(["home_key", "away_key", "at"]), ["home_key", "away_key"], join_type="inner")
        met = met.sort_by([(c, "ascending") for c in (*key, "ord")])
        heads, lines = _starts(met, key), _starts(met, [*key, "ord"])
        day, n = best_days(heads, lines, met.column("at").to_numpy(), known.column("first").to_numpy(), known.column("bits"), window)
        pools = met.select(key).take(pa.array(heads))
        return pa.table([*pools.columns, pa.array(day, pa.int32()), pa.array(n, pa.int64())], names=[*key, "day", "n"])

    schema = ", ".join([*[f"{k} {types[k]}" for k in key], "day int, n bigint"])
    found = rows.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(best, schema)
    return found.where(F.col("n") >= minimum).select(*key, F.date_from_unix_date("day").alias("day"), "n")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calendars as the first day and a bit for every day from it on."""
    for batch in batches:
        first, bits = [], []
        for days in batch.column("days"):
            days = days.values.to_numpy()
            marks = np.zeros(days.max() - days.min() + 1, np.uint8)
            marks[days - days.min()] = 1
            first.append(days.min())
            bits.append(np.packbits(marks).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("home_key"), batch.column("away_key"), pa.array(first, pa.int32()), pa.array(bits, pa.binary())],
                                         ["home_key", "away_key", "first", "bits"])


def _starts(rows: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Where a new value of the columns starts in sorted rows."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in columns:
        values = rows.column(c).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def best_days(heads: np.ndarray, lines: np.ndarray, calendar: np.ndarray, first: np.ndarray, bits: pa.ChunkedArray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Day and number of supporting matches of every pool.

    ``heads`` and ``lines``: where a pool, and a match, starts in the rows; ``calendar``: the row of ``first`` and ``bits`` of
    each. The same match met several times supports a day once.
    """
    day, n = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
    if not len(heads):
        return day, n
    packed = [np.frombuffer(b.as_buffer(), np.uint8) for b in bits]
    ends = first + np.array([8 * len(b) for b in packed])
    at_once = max(1, CELLS // int(ends.max() - first.min() + window))
    stops = np.append(heads[1:], len(calendar))
    pool = 0
    while pool < len(heads):
        upto = max(pool + 1, int(np.searchsorted(stops, heads[pool] + at_once, "right")))
        low, high = heads[pool], stops[upto - 1]
        used, row = np.unique(calendar[low:high], return_inverse=True)
        origin = int(first[used].min()) - window
        own = np.zeros((len(used), int(ends[used].max()) - origin), np.uint8)
        for i, c in enumerate(used):
            own[i, first[c] - origin:ends[c] - origin] = np.unpackbits(packed[c])
        near = own.copy()
        for k in range(1, window + 1):
            near[:, :-k] |= own[:, k:]
        inside = lines[np.searchsorted(lines, low):np.searchsorted(lines, high)] - low
        part = slice(pool, upto)
        day[part], n[part] = _most_supported(own, near, row, heads[part] - low, inside, window)
        day[part] += origin
        pool = upto
    return day, n


def _most_supported(own: np.ndarray, near: np.ndarray, row: np.ndarray, heads: np.ndarray, lines: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First day with the most matches, and their number; ``near`` marks the days of ``own`` and the ``window`` days before each."""
    if len(lines) == len(row):
        support, line = near, row
    else:
        support, line = np.maximum.reduceat(near[row], lines, axis=0), np.arange(len(lines))
    begin = np.searchsorted(lines, heads)
    sizes = np.diff(np.append(begin, len(lines)))
    order = np.argsort(-sizes, kind="stable")
    counts = np.zeros((len(heads), own.shape[1]), np.uint8 if sizes.max() < 256 else np.int32)
    for i in range(sizes.max()):
        some = order[:np.count_nonzero(sizes > i)]
        counts[:len(some)] += support[line[begin[some] + i]]
    top, n = np.empty(len(heads), np.int64), np.empty(len(heads), np.int64)
    top[order] = counts.argmax(axis=1)
    n[order] = counts.max(axis=1)
    # A day counts only if a fixture lies on it: the first one at or after the day found is supported as well.
    of_row = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(row))))
    day = np.full(len(heads), -1)
    for k in range(window + 1):
        met = np.logical_or.reduceat(own[row, np.minimum(top[of_row] + k, own.shape[1] - 1)] > 0, heads)
        day = np.where((day < 0) & met, top + k, day)
    return day, n


def with_manual(skeleton: DataFrame, manual: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Manual anchors override the skeleton with a fixed weight; disagreements are returned beside it."""
    key = list(key)
    hand = manual.select(*key, F.col("day").alias("manual_day"))
    joined = skeleton.select(*key, "day", "n").join(hand, key, "full_outer")
    merged = joined.select(*key, F.coalesce("manual_day", "day").alias("day"),
                           F.when(F.col("manual_day").isNotNull(), F.lit(MANUAL_WEIGHT).cast("long")).otherwise(F.col("n")).alias("n"))
    return merged, joined.where("manual_day IS NOT NULL AND day IS NOT NULL AND day != manual_day").select(*key, "day", "manual_day")


def admit(skeleton: DataFrame, candidates: DataFrame, group: Sequence[str] = ("pool_type",), key: str = "pool_id", *,
          width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """Supplementary anchors with ``verdict``: admitted when both skeleton neighbours bracket the day.

    A candidate without a skeleton anchor on either side is left out (verdict null).
    """
    pair = [*group, key]
    extra = candidates.join(skeleton.select(*pair), pair, "left_anti").select(*pair, "day", "n", F.lit(False).alias("sure"))
    rows = skeleton.select(*pair, "day", "n", F.lit(True).alias("sure")).unionByName(extra)
    near = neighbours(rows, list(group), key, {"sure": F.when(F.col("sure"), F.col("day"))}, width=width, levels=levels)
    inside = F.col("day").between(F.col("prev_sure"), F.col("next_sure"))
    bracketed = F.col("prev_sure").isNotNull() & F.col("next_sure").isNotNull()
    return near.select(*pair, "day", "n", F.when(F.col("sure"), "squelette").when(~bracketed, F.lit(None).cast("string"))
                       .when(inside, "admise").otherwise("refusée").alias("verdict"))


def two_step_anchors(matches: DataFrame, fixtures: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Sure skeleton, manual anchors, bracketed supplements, chronology again: final anchors."""
    candidates = cut_lineage(anchors(matches, fixtures, EXTRA_FIXTURES))
    sure = chronological(candidates.where(F.col("n") >= SURE_FIXTURES), ["pool_type"], "pool_id", "day")
    sure = sure.where("kept").drop("kept")
    if manual is not None:
        sure, _ = with_manual(sure, manual, ["pool_type", "pool_id"])
    admitted = admit(cut_lineage(sure), candidates).where("verdict IN ('squelette', 'admise')")
    return chronological(cut_lineage(admitted), ["pool_type"], "pool_id", "day").where("kept").drop("kept", "verdict")


def interpolate(anchored: DataFrame, pools: DataFrame, group: Sequence[str] = ("pool_type",), key: str = "pool_id", *,
                width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """A date with its provenance for every pool: anchored, interpolated between anchors, or one bound only."""
    pair = [*group, key]
    rows = pools.select(*pair).distinct().join(anchored.select(*pair, "day", "n"), pair, "left")
    anchor = F.when(F.col("day").isNotNull(), F.struct(F.col(key).alias("id"), "day"))
    near = neighbours(rows, list(group), key, {"a": anchor}, width=width, levels=levels)
    a, b = F.col("prev_a"), F.col("next_a")
    span = F.date_diff(b["day"], a["day"])
    # Half days go to the even day.
    moved = F.rint(span * ((F.col(key) - a["id"]) / (b["id"] - a["id"]))).cast("int")
    known, between = F.col("day").isNotNull(), a.isNotNull() & b.isNotNull()
    return near.select(
        *pair,
        F.when(known, F.col("day")).when(between, F.date_add(a["day"], moved)).alias("date"),
        F.when(known, F.col("day")).otherwise(a["day"]).alias("date_min"),
        # Beyond the last anchor only the lower bound is known, before the first only the upper one.
        F.when(known, F.col("day")).otherwise(b["day"]).alias("date_max"),
        F.when(known, BY_FIXTURES).when(between, INTERPOLATED).when(a.isNotNull() | b.isNotNull(), OUTSIDE).alias("source"),
        F.when(known, F.col("n").cast("int")).alias("concordant"),
        F.when(~known & between, span).alias("uncertainty")).where("source IS NOT NULL")


def dating_report(dated: DataFrame, tight: int = TIGHT_DAYS) -> DataFrame:
    return dated.groupBy("source").agg(
        F.count("*").alias("pools"), F.count_if(F.col("uncertainty") <= tight).alias("tight"),
        F.min("date").alias("first"), F.max("date").alias("last"))
