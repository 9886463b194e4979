import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from poolspark import scale as S
from poolspark.operators import dating as D
from poolspark.operators import ingest as I
from poolspark.operators import resample as B
from poolspark.plans.ingest import predecessor_link


def _rows(spark, n=400, seed=3):
    rnd = random.Random(seed)
    ids = rnd.sample(range(2000), n)
    return spark.createDataFrame([(rnd.choice("aab"), i, rnd.choice([None, rnd.randrange(50)])) for i in ids], "g string, id long, v int")


def test_neighbours_equal_the_plain_window(spark):
    rows = _rows(spark)
    w = Window.partitionBy("g").orderBy("id")
    plain = rows.select("g", "id", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("p"),
                        F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("n"))
    for width, levels in ((7, 2), (50, 1), (5000, 0)):
        got = S.neighbours(rows, ["g"], "id", {"v": F.col("v")}, width=width, levels=levels).select("g", "id", "prev_v", "next_v")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_running_total_equals_the_plain_window(spark):
    rows = _rows(spark).withColumn("x", F.col("id") % 5)
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    plain = rows.select("g", "id", F.coalesce(F.sum("x").over(w), F.lit(0)).alias("t"))
    for width, levels in ((7, 2), (50, 1)):
        got = S.running_total(rows, ["g"], "id", "x", "t", width=width, levels=levels).select("g", "id", "t")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_order_statistics_are_exact_with_ties_and_a_rough_sketch(spark):
    rnd = random.Random(5)
    for n in (1, 2, 5, 99, 100, 1777):
        values = sorted(rnd.choice([0.0, rnd.random() * 10]) for _ in range(n))
        df = spark.createDataFrame([(v,) for v in values], "v double")
        c = F.col("n")
        got = S.order_statistics(df, "v", {"q1": (0.25, F.floor(c / 4)), "m": (0.5, F.floor(c / 2)), "q3": (0.75, F.floor(3 * c / 4))},
                                 accuracy=200).first()
        assert (got.q1, got.m, got.q3) == (values[n // 4], values[n // 2], values[3 * n // 4]), n


def test_top_share(spark):
    for n in (50, 100, 250, 1000):
        values = [float(i % 37) for i in range(n)]
        got = B.top_share_frame(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
        best = sorted(values, reverse=True)[:max(1, n // 100)]
        assert abs(got.top_share - sum(best) / sum(values)) < 1e-12


def test_head_trim(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.0, 0.0, 100.0)], "v double")
    assert B.head_trimmed(df, "v", k=1).first().trimmed == 0.0
    assert B.head_trimmed(df, "v", k=4).first().trimmed == 0.0
    df = spark.createDataFrame([(float(x),) for x in (3, 3, 3, 3, 9, 9, 9)], "v double")
    assert B.head_trimmed(df, "v").first().trimmed == 12 / 7


def test_bootstrap_contract(spark):
    df = spark.createDataFrame([(i, float(i % 10), 2.0) for i in range(60)], "id long, v double, c double")
    for method in ("resample", "poisson"):
        got = {r.name: r for r in B.bootstrap_interval(df, ["v", "c"], "id", 200, method=method).collect()}
        assert got["v"].low < 4.5 < got["v"].high
        assert got["c"].low == got["c"].high == 2.0


def test_split_half(spark):
    df = spark.createDataFrame([(i, f"2020-01-{1 + i // 3:02d}") for i in range(11)], "id long, d string").withColumn("d", F.col("d").cast("date"))
    halves = {r.id: r.half for r in B.split_half(df, "d", "id").collect()}
    assert [halves[i] for i in range(11)] == ["A"] * 5 + ["B"] * 6


def _longest(days):
    """Quadratic rule: earliest predecessor reaching the length, earliest end of maximal length."""
    length, parent = [1] * len(days), [-1] * len(days)
    for i in range(len(days)):
        for j in range(i):
            if days[j] <= days[i] and length[j] + 1 > length[i]:
                length[i], parent[i] = length[j] + 1, j
    i, keep = length.index(max(length)), set()
    while i != -1:
        keep.add(i)
        i = parent[i]
    return keep


def test_chronology_matches_the_quadratic_rule(spark):
    rnd = random.Random(11)
    rows, expected = [], {}
    for g in range(6):
        days = [max(0, i // 2 + rnd.choice([0, 0, 0, 1, -1, 2, -3, 40, -20])) for i in range(60)]
        expected[g] = _longest(days)
        rows += [(g, i * 3 + 1, d) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "g int, id long, d int").withColumn("day", F.date_from_unix_date("d")).drop("d")
    for span in (1, 7, 50, 1024):
        got = D.chronological(df, ["g"], "id", "day", span=span).where("kept").collect()
        assert {g: {(r.id - 1) // 3 for r in got if r.g == g} for g in expected} == expected


@pytest.mark.parametrize("seed", range(4))
def test_chronology_over_many_buckets(spark, seed):
    rnd = random.Random(seed)
    # Few days, so that lengths tie; keys beyond 2^53, with gaps and below zero; a far-off day at the start of one group.
    rows, expected = [], {}
    for g in range(5):
        days = [rnd.randrange(3 + 9 * g) for _ in range(120)] if g < 3 else [i // 4 for i in range(120)]
        if g == 4:
            days[1] = 90_000
        base = rnd.choice([-200, 2**60 + 1])
        keys = sorted(rnd.sample(range(base, base + 400), len(days)))
        expected[f"g{g}"] = {keys[i] for i in _longest(days)}
        rows += [(f"g{g}", k, d) for k, d in zip(keys, days)]
    df = spark.createDataFrame([*rows, (None, 1, 1), ("g0", 999, None)], "g string, id long, d int").withColumn("day", F.date_from_unix_date("d"))
    got = D.chronological(df, ["g"], "id", "day", span=16).collect()
    assert len(got) == len(rows)
    assert {g: {r.id for r in got if r.g == g and r.kept} for g in expected} == expected


def test_a_far_off_day_leaves_groups_bounded(spark):
    # Nothing parts the rows before and after it; a bucket is what a task holds, whatever the disorder.
    rows = spark.range(6000).select(F.col("id"), F.expr("date_add(date'2020-01-01', cast(if(id = 0, 9000, id div 500) as int))").alias("day"))
    out = D.chronological(rows, [], "id", "day", span=256)
    assert out.where("kept").count() == 5999 and out.where("not kept").first().id == 0


def test_chronology_of_nothing(spark):
    df = spark.createDataFrame([], "g int, id long, day date")
    assert D.chronological(df, ["g"], "id", "day").count() == 0


def test_predecessor_of_a_page_is_that_of_its_array(spark):
    rng = random.Random(6)
    rows = [(p, f"u{rng.randrange(50)}", rng.choice([None, *range(8)]), p % 9) for p in range(60) for _ in range(rng.randint(1, 5))]
    links = spark.createDataFrame(rows, "page int, url string, number int, wanted int")
    arrays = links.groupBy("page", "wanted").agg(F.collect_list(F.struct("url", "number")).alias("links"))
    want = {r.page: r.previous for r in arrays.select("page", I.predecessor(F.col("links"), F.col("wanted")).alias("previous")).collect()}
    got = {r.page: r.previous for r in I.page_predecessor(links, ["page"], "url", "number", "wanted").collect()}
    assert got == want and len(set(got.values())) > 5


def test_predecessor_query_holds_no_page_as_an_array(spark, tmp_path):
    spark.createDataFrame([(i, i % 3) for i in range(300)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    out = predecessor_link(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    assert {r.page: r.previous for r in out.collect()} == {0: 297, 1: 37, 2: 77}


def test_nth_key_by_counting(spark):
    keys = [-(1 << 60), -5, 0, 0, 0, 7, 1 << 40, (1 << 40) + 1, (1 << 62) + 3]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert [B.nth_key(df, "k", i) for i in range(len(keys))] == sorted(keys)


def test_split_half_with_keys_beyond_36_bits_and_missing_days(spark):
    rows = [(None, 5), (None, 1 << 50)] + [("2020-01-01", (1 << 40) + k) for k in range(5)] + [("2020-01-02", k) for k in range(4)]
    df = spark.createDataFrame(rows, "d string, k long").withColumn("d", F.to_date("d"))
    got = {(str(r.d) if r.d else None, r.k) for r in B.split_half(df, "d", "k").where("half = 'A'").collect()}
    assert got == {(None, 5), (None, 1 << 50), *[("2020-01-01", (1 << 40) + k) for k in range(3)]}
    assert B.split_half(df.where("k < 0"), "d", "k").count() == 0


def test_partial_vectors_equal_a_plain_loop(spark):
    rows = [(k * 12_345_678_901, float(k % 7) - 2.5, float(k)) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, x double, y double").repartition(3)
    got = {r.b: (r.x, r.y) for r in B.replicate_means(df, ["x", "y"], "k", 40, method="poisson").collect()}
    limits = B.poisson_limits()
    for b in range(40):
        weights = []
        for k, _, _ in rows:
            a = (b * 40503 + k % B.MODULUS * 9973 + B.SEED) % B.MODULUS
            c = (a * a + 7) % B.MODULUS
            weights.append(sum((c * c + 3) % B.MODULUS >= limit for limit in limits))
        want = [sum(w * r[i] for w, r in zip(weights, rows)) / sum(weights) for i in (1, 2)]
        assert got[b] == pytest.approx(want)
    plan = B.replicate_means(df, ["x"], "k", 40, method="poisson")._jdf.queryExecution().toString()
    assert "Generate" not in plan and B.replicate_means(df.where("k < 0"), ["x"], "k", 40, method="poisson").count() == 0
