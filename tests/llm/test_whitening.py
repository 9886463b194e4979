"""Whitening against a plain computation with numpy, and hard rows."""

import math

import numpy as np
import pytest

from poolspark.llm import whitening

SCHEMA = "vec_id long, vec array<float>, whitened string, block string"


def plain(rows):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum(int(n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    centred = np.array([[float(n * c - s) / n for c, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    return deviation, centred @ axes / np.sqrt(values), values / np.trace(cov)


@pytest.mark.parametrize("n,dims,entries,parts", [(300, 5, 64, 3), (200, 40, 1 << 17, 1), (130, 33, 33 * 7, 4)])
def test_equals_numpy(spark, n, dims, entries, parts):
    rng = np.random.default_rng(n)
    mix = rng.normal(size=(dims, dims))
    rows = [(i, [float(c) for c in np.float32(rng.normal(size=dims) @ mix)]) for i in range(n)]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(parts)
    got = whitening.whiten(frame, block_entries=entries).collect()
    k = min(32, dims)
    assert len(got) == n * k
    deviation, white, explained = plain(rows)
    seen = np.full((n, k), np.nan)
    for r in got:
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-8
        seen[r["vec_id"], r["component"] - 1] = r["whitened"]
    for c in range(k):
        sign = np.sign(seen[0, c] * white[0, c])
        assert np.allclose(seen[:, c], sign * white[:, c], atol=1e-7)


def test_hard_rows(spark):
    good = [(i, [float(i % 7), float(i * i % 11)]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [float("inf"), 0.0]), (105, [3e38, 0.0]), (106, [1.0, 2.0, 3.0])]
    extra = [(None, [2.0, 5.0]), (3, good[3][1])]
    frame = spark.createDataFrame([(*r, "a", "b") for r in good + bad + extra], SCHEMA).repartition(3)
    got = whitening.whiten(frame, block_entries=10).collect()
    assert len(got) == 2 * 42 and {r["n"] for r in got} == {42}
    assert {r["vec_id"] for r in got} == {*range(40), None}
    assert sum(r["vec_id"] == 3 for r in got) == 4


def test_without_variance_and_empty(spark):
    same = spark.createDataFrame([(i, [1.0, float(i), 2.0], "", "") for i in range(5)], SCHEMA)
    got = whitening.whiten(same).collect()
    assert len(got) == 15 and {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True), (3, True)}
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "", "")], SCHEMA)).collect()
    assert [(r["whitened"], r["deviation"], r["explained"], r["identity_error"]) for r in one] == [(None, 0, 0.0, 0.0)] * 2
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == [r for r in ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]]


def test_deviation_beyond_a_long():
    whole = np.array([[0, 1 << 40], [0, -(1 << 40)], [1, 0]], np.int64)
    total = whole.sum(axis=0)
    got = whitening._deviations(whole, total, 3)
    assert got[0] is None and got[1] is None and got[2] == 4 + (0 - int(total[1])) ** 2
