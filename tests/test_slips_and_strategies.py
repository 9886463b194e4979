import itertools
import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolspark.operators import crowd as K
from poolspark.operators import market as M
from poolspark.operators import publish as U
from poolspark.operators import slips as S
from poolspark.operators import strategies as X


def frame(spark, choices):
    return spark.createDataFrame([(1, choices)], "pool_id long, choices array<array<int>>")


def test_count_does_not_enumerate(spark):
    big = frame(spark, [[0, 1, 2]] * 15)
    r = big.select(S.slip_count("choices").alias("n"), S.enumeration_status("choices").alias("s")).first()
    assert (r.n, r.s) == (3 ** 15, "refused") and S.enumerate_slips(big).count() == 0
    empty = frame(spark, [[0], []])
    assert empty.select(S.enumeration_status("choices").alias("s")).first().s == "empty"


def test_enumeration_order(spark):
    sets = [[0], [0, 1], [0, 1, 2]]
    got = [r.picks for r in S.enumerate_slips(frame(spark, sets)).orderBy("slip_ix").collect()]
    assert got == [list(p) for p in itertools.product(*sets)]


def measures(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(S.from_text("t").alias("picks"))
    return row.select("picks", *S.measures()).first()


def test_measures(spark):
    m = measures(spark, "11N2211")
    assert (m.un, m.nul, m.deux, m.suiteUn, m.suiteDeux) == (4, 1, 2, 2, 2)
    assert (m.alternances, m.symetries, m.diagonales, m.paires) == (3, 2, 1, 5)
    assert [measures(spark, t).diagonales for t in ("1N2", "2N1", "1N2N1", "1NN2")] == [1, 1, 2, 0]


def test_rules(spark):
    slips = S.enumerate_slips(frame(spark, [[0, 1, 2]] * 3)).withColumn("t", S.to_text())
    kept = lambda rules: {r.t for r in S.filter_slips(slips, rules).collect()}
    every = {"".join(p) for p in itertools.product("1N2", repeat=3)}
    assert kept(None) == every and kept({"un": {}}) == every
    assert kept({"nul": {"max": 0}}) == {t for t in every if "N" not in t}
    assert kept({"un": {"min": 2, "max": 2}}) == {t for t in every if t.count("1") == 2}
    assert kept({"combinaisons": ["1-1-1"]}) == {t for t in every if sorted(t) == sorted("1N2")}
    assert kept({"groupes": [{"matchs": [0, 1], "nul": {"max": 1}}]}) == {t for t in every if t[:2].count("N") <= 1}
    assert kept({"groupes": [{"matchs": [], "nul": {"max": 0}}, {"matchs": [9], "un": {"max": 0}}]}) == every


def test_reduction_examples(spark):
    slips = S.enumerate_slips(frame(spark, [[0, 1]] * 3))
    chosen = lambda g, **k: [S.SIGNS[r.picks[0]] + S.SIGNS[r.picks[1]] + S.SIGNS[r.picks[2]]
                             for r in S.reduce_slips(slips, ["pool_id"], g, **k).orderBy("slip_ix").collect()]
    assert len(chosen(3)) == 8 and chosen(2) == ["111", "NNN"]
    refused = S.reduce_slips(slips, ["pool_id"], 2, cap=7).collect()
    assert [(r.status, r.n_slips) for r in refused] == [("refused", 8)]
    assert [(r.status, r.n_slips) for r in S.reduce_slips(slips, ["pool_id"], 2, cap=7, total="total").collect()] == [("refused", 8)]
    many = S.enumerate_slips(frame(spark, [[0, 1, 2]] * 6))
    full, part = (S.reduce_slips(many, ["pool_id"], 4, c) for c in (1.0, 0.7))
    assert part.count() < full.count()
    picks = [tuple(r.picks) for r in full.collect()]
    assert all(max(sum(a == b for a, b in zip(s, p)) for p in picks) >= 4 for s in itertools.product(range(3), repeat=6))


def matrix_cover(picks, guarantee, coverage):
    """Brute force: agreement of all pairs, gains of all slips counted anew after each choice."""
    covers = [[sum(a == b for a, b in zip(x, y)) >= guarantee for y in picks] for x in picks]
    left, chosen = set(range(len(picks))), []
    while len(picks) - len(left) < math.ceil(coverage * len(picks)):
        gains = [sum(covers[i][j] for j in left) for i in range(len(picks))]
        if not gains or max(gains) <= 0:
            break
        chosen.append(gains.index(max(gains)))
        left -= {j for j in left if covers[chosen[-1]][j]}
    return chosen, len(picks) - len(left)


@pytest.mark.parametrize("n,guarantee,coverage,count", [(4, 3, 1.0, 81), (5, 3, 1.0, 90), (6, 5, 0.8, 120), (6, 4, 1.0, 150), (3, 5, 1.0, 20), (7, 7, 1.0, 60), (5, 0, 1.0, 30)])
def test_cover_equals_brute_force(n, guarantee, coverage, count):
    rnd = random.Random(n * 10 + guarantee)
    picks = [tuple(rnd.randrange(3) for _ in range(n)) for _ in range(count)]
    codes = np.array([sum(s * 3 ** (n - 1 - i) for i, s in enumerate(p)) for p in picks])
    assert S.greedy_cover(codes, n, guarantee, coverage) == matrix_cover(picks, guarantee, coverage)


def test_cover_of_nine_and_twelve_matches(spark):
    """Real sizes: 12 matches with 7 triples (2,187 slips), 9 with 8 (6,561), one over the cap, one too short."""
    rows = [[[0, 1, 2]] * 7 + [[0]] * 5, [[0, 1, 2]] * 8 + [[1]], [[0, 1, 2]] * 9, [[0, 1]] * 3]
    pools = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "pool_id long, choices array<array<int>>")
    out = S.reduce_slips(S.enumerate_slips(pools), ["pool_id"], 7, total="total").collect()
    by = {i: [r for r in out if r.pool_id == i] for i in range(4)}
    assert {i: {r.status for r in rs} for i, rs in by.items()} == {0: {"reduced"}, 1: {"reduced"}, 2: {"refused"}, 3: {"none"}}
    assert by[2][0].n_slips == 19_683 and (by[3][0].covered, by[3][0].slip_ix, by[3][0].picks) == (0, None, None)
    for i in (0, 1):
        kept = np.array([r.picks for r in by[i]])
        slips = np.array(list(itertools.product(*rows[i])))
        assert by[i][0].covered == len(slips) and len(kept) < len(slips)
        assert all((kept == s).sum(axis=1).max() >= 7 for s in slips)


MATCH = "struct<match_id:bigint,home:string,away:string,kickoff:date,p1:double,px:double,p2:double>"
POOL = (f"pool_id bigint, pool_type int, closed_on date, result_code string, histogram array<bigint>, "
        f"payouts array<struct<rank:int,winners:bigint,amount:double>>, matches array<{MATCH}>")


def pools(spark, n_pools=12, size=7, seed=4):
    rnd = random.Random(seed)
    rows = []
    for p in range(n_pools):
        matches = [(p * 100 + i, f"H{i}", f"A{i}", date(2020, 1, 1), 1.2 + rnd.random() * 3, 3.1 + rnd.random(), 1.5 + rnd.random() * 5)
                   for i in range(size)]
        if p == 0:  # equal matches everywhere: every tie rule is exercised
            matches = [(i, "H", "A", date(2020, 1, 1), 2.0, 3.0, 2.0) for i in range(size)]
        code = "".join(reversed([rnd.choice(["100", "010", "001"]) for _ in range(size)]))
        rows.append((p, 7, date(2020, 1, 1 + p), code, [5] * (size + 1), [(7, 1, 900.0), (6, 9, 50.0), (5, 99, 4.0)], matches))
    return spark.createDataFrame(rows, POOL), rows


def _slips(row, doubles, triples, order, triples_on):
    """Brute force: the slips of a system, match by match."""
    matches = row[6]
    probs = [[1 / o / sum(1 / x for x in m[4:]) for o in m[4:]] for m in matches]
    ranked = sorted(range(7), key=lambda j: max(probs[j]), reverse=order == X.CLEAR)
    on = triples_on or order
    t = ranked[:triples] if on == order else ranked[::-1][:triples]
    d = [j for j in ranked if j not in t][:doubles]
    best = [sorted(range(3), key=lambda i: -p[i]) for p in probs]
    return itertools.product(*[range(3) if j in t else best[j][:2] if j in d else best[j][:1] for j in range(7)])


@pytest.mark.parametrize("args", [(0, 0, X.CLEAR, None), (2, 1, X.CLEAR, None), (2, 1, X.CLEAR, X.TIGHT), (3, 2, X.TIGHT, None),
                                  (6, 1, X.CLEAR, X.TIGHT), (1, 0, X.TIGHT, None)])
def test_closed_form_payout_equals_enumeration(spark, args):
    df, rows = pools(spark)
    strategy = X.system(*args)
    got = {r.pool_id: r for r in X.playable(df).select("pool_id", X.mean_payout(strategy).alias("v"), X.slips_played(strategy).alias("n")).collect()}
    amounts = {7: 900.0, 6: 50.0, 5: 4.0}
    for row in rows:
        code = row[3]
        won = [code[(6 - j) * 3:(6 - j) * 3 + 3].index("1") for j in range(7)]
        paid = [amounts.get(sum(a == b for a, b in zip(s, won)), 0.0) for s in _slips(row, *args)]
        assert got[row[0]].n == len(paid) and got[row[0]].v == pytest.approx(sum(paid) / len(paid))


def test_double_is_the_mean_of_two_singles(spark):
    df, _ = pools(spark)
    r = X.playable(df).select(X.mean_payout(X.all_favourite()).alias("a"), X.mean_payout(X.break_favourites(1, "b")).alias("b"),
                              X.mean_payout(X.double_clearest(1, "d")).alias("d")).collect()
    assert all(x.d == pytest.approx((x.a + x.b) / 2) for x in r)


def test_unpriced_or_cancelled_pool_is_not_playable(spark):
    df, rows = pools(spark, 3)
    bad = df.withColumn("result_code", F.expr("if(pool_id = 1, concat('111', substring(result_code, 4)), result_code)"))
    assert {r.pool_id for r in X.playable(bad).collect()} == {0, 2}


def test_crowd_evaluation(spark):
    df, _ = pools(spark, 2)
    sure = df.withColumn("result_code", F.lit("100" * 7)).withColumn(
        "matches", F.expr("transform(matches, m -> named_struct('match_id', m.match_id, 'home', m.home, 'away', m.away, 'kickoff', m.kickoff, "
                          "'p1', 1.5D, 'px', 4D, 'p2', 6D))"))
    got = K.evaluate(sure).first()
    assert got.favourite == 1.0 and got.favourite_hits == 7 and got.favourite_gain == 900.0 and got.slips == 40
    assert got.crowd == pytest.approx(0.5)
    assert K.judgeable(sure.withColumn("histogram", F.expr("array(1L, 2L)"))).count() == 0


def test_flat_return(spark):
    bets = spark.createDataFrame([(1000.0, i == 0) for i in range(100)], "price double, won boolean")
    r = bets.agg(*M.flat_return()).first()
    assert r.mean_return == 10.0 and r.n == 100
    r = bets.where("false").agg(*M.flat_return()).first()
    assert (r.n, r.mean_return, r.margin) == (0, 0.0, 0.0)
    assert bets.where("won").agg(*M.flat_return()).first().margin == 0.0


@pytest.mark.parametrize("signs,prices,expected", [
    ([["1"], ["1"]], [(1.5, 4, 6), (1.2, 6, 9)], (0, 0)), ([["2"], ["N"]], [(1.5, 4, 6), (2.0, 3, 4)], (2, 1)),
    ([["N"], ["1", "N", "2"]], [(1.5, 4, 6), (1.5, 4, 6)], (1, 0)), ([["1"], None], [(1.5, 4, 6), (1.5, 4, 6)], (None, None)),
    ([["1"]], [(None, None, None)], (None, None))])
def test_surprises(spark, signs, prices, expected):
    row = spark.createDataFrame([(signs, [tuple(None if x is None else float(x) for x in p) for p in prices])],
                                "signs array<array<string>>, matches array<struct<p1:double,px:double,p2:double>>")
    small, big = U.surprises("matches", "signs")
    assert tuple(row.select(small.alias("a"), big.alias("b")).first()) == expected
