"""Longest non-decreasing run of days by key, worked out bucket by bucket.

A group may be as long as the table, so it is never handed to one task as a whole. It is split into buckets of ``span``
keys, and

1. every bucket is summed up alone: the longest run inside it for every pair of a lowest and a highest day,
2. one pass over these sums, in key order, tells every bucket the longest run that enters it at each of its days,
3. every bucket works out its own runs and hands on, for those a later bucket may go on from, where they came in,
4. one pass over these links, backwards, tells every bucket at which row the longest run leaves it,
5. every bucket marks its rows.

Steps 1, 3 and 5 hold one bucket, steps 2 and 4 one number a day. A sum is no table of pairs: a row of lowest value added to
a sequence adds itself to the ends of its runs and takes at most one other end away. So one step a row, (last day, lowest day
from which on it counts), gives the lengths of all pairs, and a sum is never longer than its bucket.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolspark.session import cut_lineage

# Keys of a bucket.
SPAN = 1 << 10
# Sorts behind every bucket: the row that says where the longest run of a group ends.
_LAST = (1 << 63) - 1
# A day behind all others.
_NEVER = 1 << 40


def chronological(rows: DataFrame, group: Sequence[str], key: str, day: str, *, span: int = SPAN) -> DataFrame:
    """Adds ``kept``: the row belongs to the longest non-decreasing run of days by key.

    Ties: among equal lengths the earliest predecessor and the earliest end win. Keys are whole numbers, unique in
    their group; rows without a group, key or day are left out.
    """
    if not 0 < span < 1 << 16:
        raise ValueError(f"span must lie in 1..{(1 << 16) - 1}")
    group = list(group)
    slim = rows.select(*group, key, F.unix_date(F.col(day)).alias("__day"), F.floor(F.col(key) / F.lit(span)).cast("long").alias("__part"))
    # Every bucket is read three times.
    dealt = cut_lineage(slim.dropna())
    return rows.join(_longest(dealt, group, key), [*group, key])


def _longest(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """(group, key, kept); ``rows``: group, key, __day, __part."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    bucket = [*group, "__part"]
    whole = group or [F.lit(0)]
    head = ", ".join(f"`{c}` {types[c]}" for c in bucket)
    n = len(bucket)

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        days, weights, _, _ = _runs(pdf, key)
        levels, steps = _sums(days, weights)
        return pd.DataFrame([(*tuple(pdf[bucket].iloc[0]), levels.tobytes(), steps.tobytes())], columns=[*bucket, "days", "steps"])

    def enter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                place = row[:n]
                if at is None or place[:-1] != at:
                    at, state = place[:-1], _State()
                levels = np.frombuffer(row[n], np.int64)
                length = state.at(levels)
                total = _through(np.frombuffer(row[n + 1], np.uint16), length)
                out.append((*place, length.tobytes(), state.since(total).tobytes()))
                state.pass_on(levels, total)
            yield pd.DataFrame(out, columns=[*bucket, "length", "since"])

    def linked(pdf: pd.DataFrame, entering: pd.DataFrame) -> pd.DataFrame:
        days, weights, ends, _ = _runs(pdf, key)
        come, since = _entering(entering)
        rank = np.unique(days, return_inverse=True)[1]
        length, parent, outer = _solve(days, weights, come)
        source: list = []
        for i, p in enumerate(parent):
            source.append(source[p] if p >= 0 else (outer[i], int(days[i])))
        best, holder = (0, 0), {}
        for i in np.lexsort((np.arange(len(days)), days)).tolist():
            if (length[i], -i) > best:
                best = (length[i], -i)
                # Only the last of a day counts: ``since`` goes with its length.
                holder[int(rank[i])] = i
        held = list(holder.values())
        first = tuple(pdf[bucket].iloc[0])
        return pd.DataFrame([(*first, int(days[i]), int(ends[i]), length[i], int(since[rank[i]]), *source[i]) for i in held],
                            columns=[*bucket, "day", "holder", "length", "since", "before", "upto"])

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, wanted, upto = None, 0, 0
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                place, (day, holder, length, since, before, last) = row[:n], row[n:]
                if place[-1] == _LAST:
                    at, wanted, upto = place[:-1], before, last
                elif at == place[:-1] and wanted == length and day <= upto < since:
                    # The latest such day of a bucket is its earliest row; before ``since`` no earlier bucket holds one.
                    out.append((*place, holder))
                    wanted, upto = before, last
            yield pd.DataFrame(out, columns=[*bucket, "leaves"])

    def marked(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        days, weights, ends, run = _runs(pdf, key)
        keep = np.zeros(len(days), bool)
        if told["found"].iloc[0]:
            _, parent, _ = _solve(days, weights, _entering(told)[0])
            i = int(np.flatnonzero(ends == told["leaves"].iloc[0])[0])
            while i >= 0:
                keep[i] = True
                i = parent[i]
        return pdf.sort_values(key, ignore_index=True)[[*group, key]].assign(kept=keep[run])

    def together(right: DataFrame):
        return rows.groupBy(*bucket).cogroup(right.groupBy(*bucket))

    sums = rows.groupBy(*bucket).applyInPandas(summed, f"{head}, days binary, steps binary")
    entering = cut_lineage(sums.repartition(*whole).sortWithinPartitions(*bucket)
                           .mapInPandas(enter, f"{head}, length binary, since binary"))
    links = cut_lineage(together(entering).applyInPandas(
        linked, f"{head}, day long, holder long, length long, since long, before long, upto long"))
    # No null among the numbers: pandas would turn them to floating point and lose digits of large keys.
    finish = links.groupBy(*group).agg(F.max("length").alias("before")).where("before is not null").select(
        *group, F.lit(_LAST).alias("__part"), *[F.lit(0).cast("long").alias(c) for c in ("day", "holder", "length", "since")], "before",
        F.lit(_NEVER - 1).cast("long").alias("upto"))
    steps = links.unionByName(finish)
    leaving = (steps.repartition(*whole).sortWithinPartitions(*group, F.col("__part").desc(), F.col("day").desc())
               .mapInPandas(follow, f"{head}, leaves long"))
    told = entering.join(leaving, bucket, "left").withColumn("found", F.col("leaves").isNotNull()).withColumn(
        "leaves", F.coalesce("leaves", F.lit(0)))
    return together(told).applyInPandas(marked, ", ".join([*[f"`{g}` {types[g]}" for g in group], f"`{key}` {types[key]}", "kept boolean"]))


def _runs(pdf: pd.DataFrame, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in key order as runs of equal neighbouring days: (days, sizes, last keys, run of every row)."""
    pdf = pdf.sort_values(key, ignore_index=True)
    day, keys = pdf["__day"].to_numpy(np.int64), pdf[key].to_numpy(np.int64)
    last = np.append(day[1:] != day[:-1], True)
    run = np.concatenate([[0], np.cumsum(last[:-1])])
    return day[last], np.bincount(run), keys[last], run


def _sums(days: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct days, steps): a step is (last day, lowest day from which on it counts, how often), days by their rank.

    A binary indexed tree of prefix maxima whose nodes hold one number for every lowest day gives the length of the longest
    run of each pair of a lowest and a highest day; the steps are where it grows with the highest one.
    """
    levels, rank = np.unique(days, return_inverse=True)
    size = len(levels)
    tree = np.zeros((size + 1, size), np.int32)

    def upto(node: int, lows: int) -> np.ndarray:
        best = np.zeros(lows, np.int32)
        while node > 0:
            np.maximum(best, tree[node, :lows], out=best)
            node -= node & -node
        return best

    for r, w in zip(rank.tolist(), weights.tolist()):
        entry = upto(r + 1, r + 1) + w
        node = r + 1
        while node <= size:
            np.maximum(tree[node, :r + 1], entry, out=tree[node, :r + 1])
            node += node & -node
    best = np.stack([upto(e + 1, size) for e in range(size)], 1)
    grows = np.triu(np.diff(best, axis=1, prepend=0))
    fresh = np.triu(np.diff(grows, axis=0, prepend=0))
    low, last = np.nonzero(fresh)
    return levels.astype(np.int64), np.stack([last, low, fresh[low, last]], 1).astype(np.uint16)


def _through(steps: np.ndarray, length_in: np.ndarray) -> np.ndarray:
    """Length of the longest run up to each day of a bucket, entered with ``length_in`` or not."""
    last, low, count = steps.reshape(-1, 3).T.astype(np.int64)
    size = len(length_in)
    fresh = np.zeros((size, size), np.int32)
    fresh[low, last] = count
    best = np.triu(np.cumsum(fresh, 0, dtype=np.int32)).cumsum(1, dtype=np.int32)
    # Lengths that enter count from the least one on, so that small numbers do.
    least = int(length_in[0])
    best += (length_in - least)[:, None].astype(np.int32)
    # Above its highest day a lowest one counts nothing: what enters there may be more than any run.
    return np.triu(best).max(0).astype(np.int64) + least


class _State:
    """Longest run of the rows so far by its last day: a length for every day at which it grows.

    Plain arrays that are changed in place: a bucket touches the days that lie between its own ones.
    """

    def __init__(self):
        self.day, self.length = array("q"), array("q")

    def at(self, days: np.ndarray) -> np.ndarray:
        """Length of the longest run that ends on each day or before; 0: none."""
        if not self.day:
            return np.zeros(len(days), np.int64)
        place = np.searchsorted(np.frombuffer(self.day, np.int64), days, "right")
        return np.where(place > 0, np.frombuffer(self.length, np.int64)[place - 1], 0)

    def since(self, lengths: np.ndarray) -> np.ndarray:
        """First day on which a run of each length, or a longer one, has ended."""
        if not self.day:
            return np.full(len(lengths), _NEVER)
        place = np.searchsorted(np.frombuffer(self.length, np.int64), lengths, "left")
        known = np.frombuffer(self.day, np.int64)[np.minimum(place, len(self.day) - 1)]
        return np.where(place < len(self.day), known, _NEVER)

    def pass_on(self, levels: np.ndarray, total: np.ndarray) -> None:
        """Go on behind a bucket whose longest run up to each of its days is ``total``."""
        low = bisect_left(self.day, int(levels[0]))
        # Days behind the bucket's last one keep their length where it is above that of its last day.
        high = max(bisect_right(self.day, int(levels[-1])), bisect_right(self.length, int(total[-1])))
        own, length = np.array(self.day[low:high], np.int64), np.array(self.length[low:high], np.int64)
        before = self.length[low - 1] if low else 0
        day = np.union1d(own, levels)
        length = np.concatenate([[before], length])[np.searchsorted(own, day, "right")]
        length = np.maximum(length, total[np.searchsorted(levels, day, "right") - 1])
        turn = length > np.concatenate([[before], length[:-1]])
        self.day[low:high] = array("q", day[turn].tobytes())
        self.length[low:high] = array("q", length[turn].tobytes())


def _entering(told: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(told["length"].iloc[0], np.int64), np.frombuffer(told["since"].iloc[0], np.int64)


def _solve(days: np.ndarray, weights: np.ndarray, length_in: np.ndarray) -> tuple[list, list, list]:
    """Per run of a bucket: length of the best run that ends there, its predecessor in the bucket (or -1), the length it
    goes on from outside (0: none). ``length_in`` holds what enters at each distinct day."""
    levels, rank = np.unique(days, return_inverse=True)
    size = len(levels)
    come = length_in.tolist()
    best_at = [(0, 0)] * (size + 1)  # per tree node: (length, -index of its first holder)
    length, parent, outer = [], [], []
    for i, (r, w) in enumerate(zip(rank.tolist(), weights.tolist())):
        best, node = (0, 0), r + 1
        while node > 0:
            best = max(best, best_at[node])
            node -= node & -node
        inside = best[0] > come[r]
        length.append(max(best[0], come[r]) + w)
        parent.append(-best[1] if inside else -1)
        outer.append(0 if inside else come[r])
        entry, node = (length[i], -i), r + 1
        while node <= size:
            best_at[node] = max(best_at[node], entry)
            node += node & -node
    return length, parent, outer
