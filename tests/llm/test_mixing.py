"""Mixing: water-filled targets, exact cuts against a plain loop, hard rows, whole passes."""

import re

import pytest
from pyspark.sql import functions as F

from poolspark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, taken int, __key string"


def plain_targets(sizes: dict, weights=(3, 1, 2), most=2):
    """Rounds of handing on: everybody gets by weight, who is above the bound stops there."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, budget = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        left, total = budget - sum(full.values()), sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return {**full, **share}
        full |= {s: float(most * sizes[s]) for s in above}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5, "d": 70}, {None: 400, "z": 3, "é": 20, "Z": 9}, {"a": 0, "b": 7}, {"only": 11}])
def test_targets_equal_rounds_of_handing_on(spark, sizes):
    totals = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(totals, (3, 1, 2), (3, 2), 2).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(want)
    for s, t in want.items():
        assert got[s] == pytest.approx(t)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def rows(n=300):
    out = []
    for i in range(n):
        source = ["hot", "hot", "hot", "b", "c", None][i % 6]
        out.append((i, " ".join(f"w{i}x{j}" for j in range(i % 17)), source, "clash", 1, "clash"))
    return out


def test_each_source_meets_its_budget_and_reruns_agree(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    out = mixing.allot(docs)
    got = out.groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert len(got) == 4
    for r in got:
        assert r["taken"] == int(r["target"]) and r["over"] <= 0
    again = {tuple(r) for r in mixing.allot(docs.repartition(2)).collect()}
    assert {tuple(r) for r in out.collect()} == again
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()} == {(r[0], r[4]) for r in again}


def test_passes_hold_the_words_taken(spark):
    docs = spark.createDataFrame(rows(120), SCHEMA)
    mixed = mixing.mix(docs)
    sums = {}
    for r in mixing.passes(mixed).collect():
        words = re.findall(mixing.WORD, r["mixed_text"])
        assert r["text"].split()[:len(words)] == words and 1 <= r["epoch"] <= 2
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + len(words)
    assert sums == {r["doc_id"]: r["taken"] for r in mixed.collect() if r["taken"]}


def test_equal_rows_share_the_cut(spark):
    """A third of all rows are one row; sources are cut exactly but for less than a word per equal row."""
    docs = spark.createDataFrame([(None, "a b c", "s", "x", 0, "y")] * 40 + [(i, f"q{i} r", "s", "x", 0, "y") for i in range(60)] + [(7, "k " * 500, "t", "", 0, "")], SCHEMA)
    out = mixing.allot(docs).collect()
    assert len(out) == 101 and len({r["taken"] for r in out if r["doc_id"] is None}) == 1
    s = [r for r in out if r["size"] < 500]
    assert 0 <= int(s[0]["target"]) - sum(r["taken"] for r in s) < 40


def test_hard_rows(hard, empty):
    got = mixing.allot(hard)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert got.count() == hard.count() and got.where("taken is null or target is null").count() == 0
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert [by_id[i]["size"] for i in (0, 1, 2)] == [0, 0, 0] and by_id[8]["size"] == 30_000
    assert mixing.mix(hard).count() == hard.count()
    assert mixing.allot(empty).count() == 0 and mixing.passes(mixing.mix(empty)).count() == 0
