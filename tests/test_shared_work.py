"""Work that equal parts of the data share is done once, with the results of the plain form."""
import random

import numpy as np
import pyarrow as pa

from poolspark.operators import dating as D
from poolspark.operators import resample as B
from poolspark.operators import slips as S
from poolspark.operators import strategies as X
from poolspark.plans import load
from poolspark.sources import views as V

SF = "/root/testdata/sf0.001"


def test_multi_slips_of_one_shape_are_reduced_together(spark):
    rows = [[[0, 1], [2], [1, 2], [0, 1, 2], [0, 2]], [[1, 2], [0], [0, 2], [2, 0, 1], [0, 1]], [[0, 0], [1], [1, 2], [0, 1, 2], [2, 2]], [[0], []]]
    pools = spark.createDataFrame(list(enumerate(rows)), "pool_id long, choices array<array<int>>").withColumn("shape", S.shape())
    kinds = S.reduce_shapes(pools, 3).cache()
    assert kinds.select("shape").distinct().count() == 3  # the first two pools have one shape
    mine = pools.join(kinds.drop("picks"), "shape").withColumn("picks", S.picks_at())
    plain = S.reduce_slips(S.enumerate_slips(pools), ["pool_id"], 3)
    fields = ["pool_id", "slip_ix", "picks", "n_slips", "covered", "status"]
    got = sorted(map(repr, mine.where("status = 'reduced'").select(fields).collect()))
    assert got == sorted(map(repr, plain.select(fields).collect())) and len(got) == 5
    assert [(r.status, r.picks) for r in mine.where("pool_id = 3").collect()] == [("empty", None)]


def test_draws_are_looked_up_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 32)
    monkeypatch.setattr(B, "PIECE", 8)
    monkeypatch.setattr(B, "SHARE", 7)
    df = spark.createDataFrame([(i * 3, float(i * i % 17) if i % 5 else None, 1.0) for i in range(75)], "id long, v double, one double").repartition(3)
    plan = B.replicate_means(df, ["v", "one"], "id", 20)
    held = [float(i * i % 17) if i % 5 else None for i in range(75)]
    for r in plan.collect():
        a = [(r.b * 40503 + i * 9973 + B.SEED) % B.MODULUS for i in range(75)]
        drawn = [held[(((x * x + 7) % B.MODULUS) ** 2 + 3) % B.MODULUS % 75] for x in a]
        known = [v for v in drawn if v is not None]
        assert abs(r.v - sum(known) / len(known)) < 1e-9 and r.one == 1.0
    # No row of a replicate and a draw is made: the join on drawn rows is gone.
    assert plan.count() == 20 and "Join Inner, (ix" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert B.replicate_means(df.where("id < 0"), ["v"], "id", 20).count() == 0


def test_days_are_counted_on_calendars_held_once(monkeypatch):
    rnd = random.Random(5)
    calendars = [sorted(rnd.sample(range(-20, 900), rnd.randrange(1, 90))) for _ in range(40)]
    bits = [np.packbits(np.isin(np.arange(c[0], c[-1] + 1), c).astype(np.uint8)).tobytes() for c in calendars]
    rows = sorted((p, rnd.randrange(5), rnd.randrange(40)) for p in range(50) for _ in range(rnd.randrange(1, 9)))
    heads = np.array([i for i, r in enumerate(rows) if i == 0 or r[0] != rows[i - 1][0]])
    lines = np.array([i for i, r in enumerate(rows) if i == 0 or r[:2] != rows[i - 1][:2]])
    want = []
    for p in range(50):
        own = {o: set().union(*[calendars[c] for q, m, c in rows if (q, m) == (p, o)]) for q, o, _ in rows if q == p}
        n, day = max((sum(any(d + k in s for k in range(4)) for s in own.values()), -d) for d in set().union(*own.values()))
        want.append((-day, n))
    for cells in (1, 9000, 1 << 25):
        monkeypatch.setattr(D, "CELLS", cells)
        day, n = D.best_days(heads, lines, np.array([r[2] for r in rows]), np.array([c[0] for c in calendars]), pa.chunked_array([pa.array(bits, pa.binary())]), 3)
        assert list(zip(day.tolist(), n.tolist())) == want


def test_equal_multi_slips_are_measured_once(spark, monkeypatch):
    from poolspark.plans import slips as plan

    rows = [[[0, 1], [2], [0, 1, 2]], [[2], [1]], [[0, 1], [2], [0, 1, 2]], [[0], []]]
    pools = spark.createDataFrame(list(enumerate(rows)), "pool_id long, choices array<array<int>>")
    monkeypatch.setattr(plan, "composed", lambda *_: pools)
    found = plan.slip_measures(spark, "")
    plain = S.enumerate_slips(pools).select("pool_id", *S.measures()).groupBy("pool_id").sum(*S.MEASURES)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and found.count() == 3
    assert "Aggregate [choices" in found._jdf.queryExecution().optimizedPlan().toString()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_halves_read_stored_rows(spark):
    """the pools are built once, not for every counting pass."""
    assert "Relation" not in plan_of(load()[0]["split_half"](spark, SF))


def test_a_line_and_its_header_are_split_once(spark):
    """conditions on cells are not moved below the split, where each would split again."""
    plan = plan_of(load()[0]["fixture_csv_scan"](spark, SF))
    assert plan.count("split(") <= 3 and plan.count("array_position") <= 2


def test_slips_are_summed_without_a_sort(spark):
    """every different multi-slip is listed once and its slips are compared as numbers."""
    listed = load()[0]["slip_enumerate"](spark, SF)
    assert "SortAggregate" not in listed._jdf.queryExecution().sparkPlan().toString().replace("ObjectHash", "")
    texts = listed.where("status = 'listed'").selectExpr("length(lowest) = length(highest) and lowest <= highest as fine").distinct().collect()
    assert [r.fine for r in texts] == [True]


def test_strategies_are_paid_by_outcome(spark):
    """the slips by number of hits are counted once per outcome, and the payouts are those of the strategy itself."""
    strategies = [*X.SCOREBOARD, *X.configurations()[::5], X.system(2, 1, X.TIGHT)]
    played = X.playable(V.pools(spark, SF)).cache()
    assert X.hit_counts(strategies[:2], "clear", 7, spark=spark).count() == 3 ** 7
    own = {r[0]: r[1:] for r in played.select("pool_id", *[X.mean_payout(s) for s in strategies]).collect()}
    got = {r[0]: r[2:] for r in X.returns(played, strategies).collect()}
    played.unpersist()
    assert own and own == got


def test_both_alias_passes_read_stored_fixtures(spark):
    """the fixtures and the contexts are derived once; only the day pass reads the matches beside them (its counts twice)."""
    assert plan_of(load()[0]["alias_merge"](spark, SF)).count("Relation") == 2
