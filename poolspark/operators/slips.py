"""Multi-slips: counting, enumeration, measures, rules, covering reduction.

A multi-slip is ``choices array<array<int>>`` (one set of outcomes 0/1/2 per match); a slip is
``picks array<int>``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Most slips enumerated, most slips reduced, slips shown in a preview.
ENUMERATION_CAP = 300_000
REDUCTION_CAP = 8_000
PREVIEW = 40
_PLACES = 1 << 21  # codes that get a place each: up to 13 matches
_NEAR = 1 << 17  # neighbours worked on at once
SIGNS = "1N2"


def slip_count(choices: str) -> Column:
    """Product of the set sizes without enumerating; an empty set counts as one."""
    return F.expr(f"aggregate({choices}, 1L, (n, c) -> n * greatest(1, size(c)))")


def summary(choices: str) -> list[Column]:
    """Singles, doubles, triples, empties, slips and cost of a multi-slip."""
    of = lambda k: F.expr(f"size(filter({choices}, c -> size(c) = {k}))")
    empties = of(0)
    total = F.when(empties > 0, F.lit(0).cast("long")).otherwise(slip_count(choices))
    return [of(1).alias("singles"), of(2).alias("doubles"), of(3).alias("triples"), empties.alias("empties"),
            total.alias("slips"), total.cast("double").alias("cost")]


def enumeration_status(choices: str, cap: int = ENUMERATION_CAP) -> Column:
    """``empty`` (no slip at all) differs from ``refused`` (too many to list)."""
    return (F.when(F.expr(f"exists({choices}, c -> size(c) = 0)"), "empty")
            .when(slip_count(choices) > cap, "refused").otherwise("listed"))


def enumerate_slips(df: DataFrame, choices: str = "choices", cap: int = ENUMERATION_CAP, total: str = "total",
                    first: int | None = None) -> DataFrame:
    """One row per slip, last match varying fastest: ``slip_ix``, ``picks`` and the pool's ``total``.

    Pools with an empty set or too many slips give none; ``unlisted`` names them. ``first`` stops each pool early.

    Each index is decoded by mixed radix, so a pool is one generator and not an n-way product.
    """
    listed = (df.where(enumeration_status(choices, cap) == "listed")
              .withColumn("__strides", F.expr(_strides(choices))).withColumn(total, slip_count(choices)))
    end = total if first is None else f"least({total}, {first}L)"
    slips = listed.select("*", F.expr(f"explode(sequence(0L, {end} - 1))").alias("slip_ix"))
    return slips.withColumn("picks", F.expr(_decoded(choices, "__strides"))).drop("__strides")


def _strides(choices: str) -> str:
    """How many slips follow before a match moves to its next sign."""
    return (f"transform({choices}, (c, i) -> aggregate(slice({choices}, i + 2, size({choices})), 1L, "
            "(n, d) -> n * size(d)))")


def _decoded(choices: str, strides: str) -> str:
    return f"zip_with({choices}, {strides}, (c, s) -> c[cast((slip_ix div s) % size(c) as int)])"


def picks_at(choices: str = "choices") -> Column:
    """The slip of a multi-slip at ``slip_ix``; null without an index."""
    return F.expr(f"if(slip_ix is null, null, {_decoded(choices, _strides(choices))})")


def shape(choices: str = "choices") -> Column:
    """The multi-slip with every sign replaced by its place in its set.

    Multi-slips of one shape have as many slips, and slips of the same two indexes agree on the same matches: whatever
    depends on agreement alone, as a covering reduction does, is found once for all of them.
    """
    return F.expr(f"transform({choices}, c -> transform(c, x -> cast(array_position(array_distinct(c), x) - 1 as int)))")


def unlisted(df: DataFrame, key: Sequence[str], choices: str = "choices", cap: int = ENUMERATION_CAP) -> DataFrame:
    """The pools ``enumerate_slips`` gives no slip for: ``status`` (``empty`` or ``refused``) and ``n_slips``."""
    status = enumeration_status(choices, cap)
    n = F.when(status == "empty", F.lit(0).cast("long")).otherwise(slip_count(choices))
    return df.select(*key, status.alias("status"), n.alias("n_slips")).where("status != 'listed'")


def preview(df: DataFrame, key: Sequence[str], choices: str = "choices", lines: int = PREVIEW) -> DataFrame:
    """The first ``lines`` slips of every listed pool and how many it has; only these are generated."""
    return enumerate_slips(df, choices, first=lines).select(*key, "slip_ix", to_text().alias("slip"), "total")


def to_text(picks: str = "picks") -> Column:
    return F.expr(f"array_join(transform({picks}, p -> substring('{SIGNS}', p + 1, 1)), '')")


def from_text(text: str) -> Column:
    return F.expr(f"transform(split({text}, ''), c -> cast(instr('{SIGNS}', c) - 1 as int))")


def sign_count(sign: int, picks: str = "picks") -> Column:
    return F.expr(f"size(filter({picks}, p -> p = {sign}))")


def longest_run(sign: int, picks: str = "picks") -> Column:
    return F.expr(
        f"aggregate({picks}, named_struct('run', 0, 'best', 0), (a, p) -> named_struct("
        f"'run', if(p = {sign}, a.run + 1, 0), 'best', greatest(a.best, if(p = {sign}, a.run + 1, 0))), a -> a.best)")


def alternations(picks: str = "picks") -> Column:
    return F.expr(f"size(filter({picks}, (p, i) -> i > 0 and p != {picks}[i - 1]))")


def symmetries(picks: str = "picks") -> Column:
    return F.expr(f"size(filter({picks}, (p, i) -> i < size({picks}) - 1 - i and p = {picks}[size({picks}) - 1 - i]))")


def diagonals(picks: str = "picks") -> Column:
    return F.expr(f"size(filter({picks}, (p, i) -> i + 2 < size({picks}) and {picks}[i + 1] = 1 "
                  f"and p != 1 and {picks}[i + 2] = 2 - p))")


def distinct_runs(size: int, picks: str = "picks") -> Column:
    """Different sequences of ``size`` consecutive signs."""
    return F.expr(f"if(size({picks}) < {size}, 0, size(array_distinct(transform(sequence(1, size({picks}) - {size} + 1), "
                  f"i -> slice({picks}, i, {size})))))")


# The rule names of the workshop and the measure each one bounds.
MEASURES = {
    "un": lambda p: sign_count(0, p), "nul": lambda p: sign_count(1, p), "deux": lambda p: sign_count(2, p),
    "suiteUn": lambda p: longest_run(0, p), "suiteNul": lambda p: longest_run(1, p),
    "suiteDeux": lambda p: longest_run(2, p), "alternances": alternations, "symetries": symmetries,
    "diagonales": diagonals, "paires": lambda p: distinct_runs(2, p), "tierces": lambda p: distinct_runs(3, p),
    "quartes": lambda p: distinct_runs(4, p),
}


def measures(picks: str = "picks") -> list[Column]:
    return [fn(picks).alias(name) for name, fn in MEASURES.items()]


def _bounded(value: Column, bound: dict) -> Column:
    test = F.lit(True)
    if bound.get("min") is not None:
        test = test & (value >= bound["min"])
    if bound.get("max") is not None:
        test = test & (value <= bound["max"])
    return test


def compile_rules(rules: dict | None, picks: str = "picks") -> Column:
    """Rule dictionary to a predicate; a rule that is not given filters nothing.

    ``groupes``: sign bounds on a subset of matches, each group checked on its own, positions beyond
    the slip ignored. ``combinaisons``: allowed ``a-b-c`` sign signatures.
    """
    rules = rules or {}
    test = F.lit(True)
    for name, measure in MEASURES.items():
        if rules.get(name):
            test = test & _bounded(measure(picks), rules[name])
    for group in rules.get("groupes") or []:
        positions = ",".join(str(int(j)) for j in group.get("matchs") or [])
        if not positions:
            continue
        for sign, name in enumerate(("un", "nul", "deux")):
            if group.get(name):
                inside = F.expr(f"size(filter(array({positions}), j -> j < size({picks}) and {picks}[j] = {sign}))")
                test = test & _bounded(inside, group[name])
    if rules.get("combinaisons"):
        signature = F.concat_ws("-", *[sign_count(s, picks).cast("string") for s in range(3)])
        test = test & signature.isin(list(rules["combinaisons"]))
    return test


def filter_slips(slips: DataFrame, rules: dict | None, picks: str = "picks") -> DataFrame:
    return slips.where(compile_rules(rules, picks))


def agreement(a: str, b: str) -> Column:
    """Matches on which two slips carry the same sign."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x)")


def agreement_of(a: Column, b: Column) -> Column:
    """The same for two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)


def presets(matches: str = "matches") -> dict[str, Column]:
    """Choice sets for a whole pool: favourite only, a given sign set, all three, none."""
    trio = "array(m.p1, m.px, m.p2)"
    quoted = "m.p1 is not null and m.px is not null and m.p2 is not null"
    favourite = (f"transform({matches}, m -> if({quoted}, "
                 f"array(cast(array_position({trio}, array_min({trio})) - 1 as int)), cast(array() as array<int>)))")
    fixed = lambda signs: F.expr(f"transform({matches}, m -> array({signs}))")
    return {"favourite": F.expr(favourite), "all": fixed("0, 1, 2"), "home_draw": fixed("0, 1"),
            "clear": F.expr(f"transform({matches}, m -> cast(array() as array<int>))")}


@lru_cache(maxsize=64)
def ball(n: int, distance: int) -> np.ndarray:
    """Ways to change at most ``distance`` of ``n`` signs: one row per way, what is added to each sign (modulo 3)."""
    ways = [np.zeros((1, n), np.int8)]
    for k in range(1, min(distance, n) + 1):
        for places in combinations(range(n), k):
            shifts = np.zeros((2 ** k, n), np.int8)
            shifts[:, places] = np.array(list(product((1, 2), repeat=k)), np.int8)
            ways.append(shifts)
    return np.concatenate(ways)


class Neighbours:
    """The given slips near some of them, from their codes alone: every code within the distance is made and looked up.

    ``codes`` ascend and are distinct; what is held is linear in their number, or one place per possible code.
    """

    def __init__(self, codes: np.ndarray, n: int, distance: int):
        self.codes = codes
        self.weights = 3 ** np.arange(n - 1, -1, -1, dtype=np.int64)
        self.signs = (codes[:, None] // self.weights % 3).astype(np.int8)
        self.ways = ball(n, distance)
        self.place = None
        if 3 ** n <= _PLACES:
            self.place = np.full(3 ** n, -1, np.int32)
            self.place[codes] = np.arange(len(codes))

    def of(self, some: np.ndarray) -> np.ndarray:
        """Indexes of the slips near each of ``some``, one after the other."""
        near = (((self.signs[some][:, None, :] + self.ways) % 3) @ self.weights).ravel()
        if self.place is not None:
            at = self.place[near]
            return at[at >= 0]
        at = np.minimum(np.searchsorted(self.codes, near), len(self.codes) - 1)
        return at[self.codes[at] == near]

    def parts(self, some: np.ndarray):
        """``some`` in parts whose neighbours fit in a bounded array."""
        step = max(1, _NEAR // len(self.ways))
        for at in range(0, len(some), step):
            yield some[at:at + step]


def greedy_cover(codes: np.ndarray, n: int, guarantee: int, coverage: float) -> tuple[list[int], int]:
    """Indexes chosen by the greedy cover (most newly covered, lowest index on ties) and the covered count.

    A slip covers those that share ``guarantee`` signs with it: the codes in a ball around its own. Every slip holds the
    number it would cover; each slip that is covered takes itself out of its neighbours' numbers, once.
    """
    total = len(codes)
    if guarantee > n or not total:
        return [], 0
    # Equal slips are one code; the lowest index stands for them, and each counts.
    distinct, index, copies = np.unique(codes, return_index=True, return_counts=True)
    near = Neighbours(distinct, n, n - guarantee)
    everything = np.arange(len(distinct))
    gains = np.zeros(len(distinct), np.int64)

    def spread(some: np.ndarray, sign: int) -> None:
        for part in near.parts(some):
            if (copies[part] == 1).all():
                gains[:] += sign * np.bincount(near.of(part), minlength=len(gains))
            else:
                for i in part:
                    gains[near.of(np.array([i]))] += sign * copies[i]

    spread(everything, 1)
    left = np.ones(len(distinct), bool)
    goal, covered, chosen = int(np.ceil(coverage * total)), 0, []
    by_index = np.argsort(index, kind="stable")
    while covered < goal:
        best = int(by_index[gains[by_index].argmax()])
        if gains[best] <= 0:
            break
        chosen.append(int(index[best]))
        own = near.of(np.array([best]))
        newly = own[left[own]]
        covered += int(copies[newly].sum())
        left[newly] = False
        spread(newly, -1)
    return chosen, covered


def reduce_slips(slips: DataFrame, key: Sequence[str], guarantee: int, coverage: float = 1.0, *,
                 cap: int = REDUCTION_CAP, order: str = "slip_ix", picks: str = "picks", total: str | None = None) -> DataFrame:
    """Greedy covering set per pool: ``status``, ``order``, ``picks`` and the covered count.

    Every pool has a row: ``none`` (nothing can be covered: fewer matches than ``guarantee``) and ``refused`` pools have one
    without a slip. Pools advance independently. A pool holding more than ``cap`` slips is refused from its count
    alone, so no group ever holds more than ``cap`` slips, each packed in one number. ``total`` names
    a column bounding the slips of a pool: pools within the cap by that bound are not counted.
    """
    key = list(key)
    kind = slips.schema[picks].dataType.simpleString()
    doubtful = slips if total is None else slips.where(F.col(total) > cap)
    refused = doubtful.groupBy(*key).agg(F.count("*").alias("n_slips")).where(F.col("n_slips") > cap)
    allowed = doubtful.join(refused.select(*key), key, "left_anti")
    packed = F.struct(F.col(order).cast("long").alias("ix"), F.expr(f"aggregate({picks}, 0L, (a, p) -> a * 3 + p)").alias("code"))
    rows = allowed.select(*key, F.size(picks).alias("n"), packed.alias("s"))
    if total is not None:
        rows = rows.unionByName(slips.where(F.col(total) <= cap).select(*key, F.size(picks).alias("n"), packed.alias("s")))
    pools = rows.groupBy(*key).agg(F.max("n").alias("n"), F.sort_array(F.collect_list("s")).alias("s")).select(
        *key, "n", F.size("s").cast("long").alias("n_slips"), F.expr("transform(s, x -> x.ix)").alias("ix"),
        F.expr("transform(s, x -> x.code)").alias("codes"))

    @F.pandas_udf("struct<ix array<bigint>, code array<bigint>, covered bigint>")
    def cover(indexes: pd.Series, codes: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        found = []
        for own, slip_codes, n in zip(indexes, codes, sizes):
            slip_codes = np.asarray(slip_codes)
            chosen, covered = greedy_cover(slip_codes, int(n), guarantee, coverage)
            found.append((np.asarray(own)[chosen], slip_codes[chosen], covered))
        return pd.DataFrame(found, columns=["ix", "code", "covered"])

    # The search costs far more than its input weighs: keep every core busy.
    cores = slips.sparkSession.sparkContext.defaultParallelism
    reduced = pools.repartition(cores, *key).withColumn("c", cover("ix", "codes", "n")).select(
        *key, "n", "n_slips", F.col("c.covered").alias("covered"), F.explode_outer(F.arrays_zip("c.ix", "c.code")).alias("s"))
    signs = F.expr("transform(sequence(1, n), k -> cast((s.code div cast(pow(3, n - k) as bigint)) % 3 as int))").cast(kind)
    kept = reduced.select(*key, F.col("s.ix").alias(order), F.when(F.col("s").isNotNull(), signs).alias(picks), "n_slips", "covered",
                          F.when(F.col("s").isNull(), "none").otherwise("reduced").alias("status"))
    none = refused.select(*key, F.lit(None).cast("long").alias(order), F.lit(None).cast(kind).alias(picks), "n_slips",
                          F.lit(None).cast("long").alias("covered"), F.lit("refused").alias("status"))
    return kept.unionByName(none)


def reduce_shapes(shapes: DataFrame, guarantee: int, coverage: float = 1.0, *, cap: int = REDUCTION_CAP) -> DataFrame:
    """``reduce_slips`` of all slips of every different ``shape``; shapes without slips, or with too many, have a row too."""
    kinds = shapes.select("shape").distinct()
    reduced = reduce_slips(enumerate_slips(kinds, "shape"), ["shape"], guarantee, coverage, cap=cap, total="total")
    return reduced.unionByName(unlisted(kinds, ["shape"], "shape"), allowMissingColumns=True)


def reduction_summary(reduced: DataFrame, key: Sequence[str]) -> DataFrame:
    """Slips kept, saving and coverage rate per pool."""
    kept = F.count("slip_ix")
    n = F.max("n_slips")
    return reduced.groupBy(*key).agg(
        F.max("status").alias("status"), kept.alias("kept"), n.alias("n_slips"),
        (n - kept).alias("saved"), F.try_divide(n - kept, n).alias("saved_share"),
        F.try_divide(F.max("covered"), n).alias("coverage"))
