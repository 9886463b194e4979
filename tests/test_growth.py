"""Work that has to grow no faster than the rows."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolspark.operators import chronology as C
from poolspark.operators import matching as J


def _lines(spark, n):
    lines = [(f"Maison {i % 5} aa{i % 7}bb", f"Visite {i % 3} cc{i % 4}dd") for i in range(n)]
    return spark.createDataFrame([(lines[::-2], lines)], "table array<struct<home:string,away:string>>, listing array<struct<home:string,away:string>>")


def test_names_of_a_page_are_read_once(spark):
    done = _lines(spark, 6).select(J.complete_lines(F.col("table"), F.col("listing")).alias("x"))
    plan = done._jdf.queryExecution().analyzed().toString()
    # Home and away, of the table and of the list; every name was cut into words at each of its comparisons.
    assert plan.lower().count("split(") == 4


def test_accents_of_plain_and_other_texts(one):
    from poolspark.functions import text as T

    assert one(T.strip_accents("a"), a="Saint-Étienne Ñandú") == "saint-etienne nandu"
    assert one(T.strip_accents("a"), a="Real Madrid 2") == "real madrid 2" and one(T.fold("a"), a=None) == ""


def _best(days, low, high):
    ends = []
    for d in (x for x in days if low <= x <= high):
        ends.append((d, 1 + max((n for e, n in ends if e <= d), default=0)))
    return max((n for _, n in ends), default=0)


@pytest.mark.parametrize("seed", range(6))
def test_a_sum_gives_every_pair_and_is_no_longer_than_its_bucket(seed):
    rnd = random.Random(seed)
    days = [rnd.randrange(4 + 9 * seed) for _ in range(70)]
    levels, steps = C._sums(np.array(days), np.ones(70, np.int64))
    assert len(steps) <= 70 and steps[:, 2].sum() == 70
    come = np.sort(np.array([rnd.randrange(40) for _ in levels]))
    expected = [max(come[a] + _best(days, levels[a], high) for a in range(i + 1)) for i, high in enumerate(levels)]
    assert C._through(steps.ravel(), come).tolist() == expected


def test_the_state_of_the_pass_equals_plain_maxima():
    rnd = random.Random(5)
    state, seen = C._State(), {}
    for _ in range(200):
        levels = np.array(sorted(rnd.sample(range(120), rnd.randint(1, 6))))
        at = lambda d: max((n for e, n in seen.items() if e <= d), default=0)
        assert state.at(levels).tolist() == [at(d) for d in levels]
        total, top = [], 0
        for d in levels:
            top = max(top, at(d)) + rnd.randint(1, 3)
            total.append(top)
        first = [min((e for e, n in seen.items() if n >= t), default=C._NEVER) for t in total]
        assert state.since(np.array(total)).tolist() == first
        state.pass_on(levels, np.array(total))
        seen.update({int(d): max(n, seen.get(int(d), 0)) for d, n in zip(levels, total)})


def test_frames_of_a_hot_pool_are_thinned_before_its_state(spark):
    from poolspark.streaming.stateful import newest_of

    rows = [("pool" if i % 3 else "match", i % 4 if i % 5 else None, f"{i // 2:020d}", f"p{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "kind string, id long, at string, payload string").coalesce(1)
    got = newest_of(df, "kind", "id").collect()
    expected = {}
    for r in rows:
        expected[r[:2]] = max(expected.get(r[:2], r), r, key=lambda x: (x[2], int(x[3][1:])))
    assert len(got) == len(expected) and {tuple(r) for r in got} == set(expected.values())


def test_a_part_is_a_micro_batch_whatever_its_files():
    from poolspark.plans.streams import files_at_once

    assert [files_at_once(f) for f in ([0, 36, 72, 108], [0, 1, 2, 3], [0, 36, 37], [0, 36, 37, 38], [0, 2, 3, 4])] == [36, 1, 36, 12, 1]


def test_parts_of_many_files_come_in_as_few_batches(spark):
    from poolspark.plans.streams import in_parts
    from poolspark.streaming import runs

    rows = spark.range(600, numPartitions=12).select(F.col("id").alias("seq"), F.concat(
        F.lit('42["m",{"pools":{"7000001":{"poolId":7000001,"poolStatus":"s'), "id", F.lit('","matches":[5]}},"matches":{"5":{"matchId":5}}}]')).alias("body"))
    report = []
    got = runs.emit_complete(in_parts(spark, rows, F.col("seq") % 3, 3, "many"), report=report).collect()
    assert len(got) == 1 and got[0].status == "s599" and len([p for p in report if p.numInputRows]) == 3


def test_parts_of_a_page_are_read_once(spark):
    from poolspark.operators import pages as H

    frame = spark.createDataFrame([("<table><tr></tr></table><table><td>1</td><td>2</td><td>3,5</td></table>",)], "html string")
    rows = H.archive_page(frame.select(F.concat("html", F.lit("")).alias("html")))
    assert rows.first().rapports[0].rapport == 3.5
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # The page is searched for tables once, and once each for the cells of its amounts.
    assert plan.count("<table.*?</table>") == 1 and plan.count("<td[^>]*>(.*?)</td>") == 1


def test_letters_are_looked_up_only_beyond_ascii(spark):
    from poolspark.functions import text as T

    rows = spark.createDataFrame([("Équipe Ñandú x",)], "t string").withColumn("apart", T.decompose("t"))
    assert rows.select((T.compose("apart") == F.col("t")).alias("same"), (F.length("apart") - F.length("t")).alias("marks")).first() == (True, 3)
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "octet_length" in plan


PRICES = "map<string,struct<p1:double,px:double,p2:double>>"


def _fixtures(spark, days):
    rows = [("a", "b", d, i % 3, 1, {"bet365": (2.0, 3.0, 4.0)}, "E0") for i, d in enumerate(days)]
    return spark.createDataFrame(rows, f"home_key string, away_key string, match_date date, goals_home int, goals_away int, prices {PRICES}, competition string")


def test_a_fixture_is_not_held_once_for_every_day_around_it(spark):
    days = [date(1969, 6, 1) + timedelta(days=i) for i in range(320)]
    lookup = J.fixture_lookup(_fixtures(spark, days + days + [None])).collect()
    held = [d for r in lookup for d in r.near]
    # Every day once, twice at the two edges of a span; before, three rows for each.
    assert {d.match_date for d in held} == set(days) and all(d.n == 2 for d in held) and len(held) <= 320 + 2 * (320 // J.SPAN + 1)
    assert max(len(r.near) for r in lookup) <= J.SPAN + 2 and len(lookup) == len({r.span for r in lookup}) <= 320 // J.SPAN + 2


@pytest.mark.parametrize("margin", [0, 1, 3])
def test_spans_give_the_candidates_of_every_day(spark, margin):
    rnd = random.Random(margin)
    known = [date(1969, 10, 1) + timedelta(days=rnd.randrange(400)) for _ in range(60)]
    days = [date(1969, 9, 20) + timedelta(days=i) for i in range(430)]
    matches = spark.createDataFrame([("a", "b", d, None, None) for d in days], "home_key string, away_key string, day date, score_home int, score_away int")
    got = {r.day: r for r in J.strict_match(matches, _fixtures(spark, known), margin=margin).collect()}
    for d in days:
        near = [k for k in known if abs((k - d).days) <= margin]
        reason = J.ABSENT if not near else J.SEVERAL if len(near) > 1 else J.SHIFTED if near[0] != d else None
        assert got[d].reason == reason and (got[d].found and got[d].found.match_date) == (None if reason else d)


def _optimized(spark, name):
    from poolspark.plans import load

    return load()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["price_attachment", "price_coverage"])
def test_matches_with_an_own_price_are_not_looked_up(spark, name):
    plan = _optimized(spark, name)
    looked_up = plan[plan.index("Join LeftOuter"):]
    # The rows of the lookup are those left over, and they carry what matching reads.
    assert "Union" in plan and "NOT ((" in looked_up and "min_by(struct(pool_type" in looked_up
    assert "array_join" not in plan and "signs" not in plan


@pytest.mark.parametrize("name", ["strict_fixture_match", "match_refusal_reasons"])
def test_matching_alone_carries_no_prices(spark, name):
    plan = _optimized(spark, name)
    assert "map_from_entries" not in plan
    assert "first(goals_home" in plan and ("first(competition" in plan) == (name == "strict_fixture_match")


def test_objects_are_searched_where_they_are_opened(spark):
    from poolspark.functions import nested as N

    deep = "[" * 300 + '{"z": {"a": 2.5, "b": 3.1, "c": 3.3}}' + "]" * 300
    bodies = ['{"a": 2.5, "b": 3.1, "c": 3.3, "d": "3.2", "e": true, "f": null, "g": -2, "h": [1], "i": "2020-01-01"}',
              '{"x": [{"a": 2, "b": "3.4", "c": 4.2, "d": 1.5e1, "e": 3.4}, [{"p": 1.9, "q": 3, "r": 5}]], "y": 2, "w": {}}',
              "{" + ", ".join(f'"k{i}": {2 + i / 10}' for i in range(13)) + "}", '{"a": 2.5, "b": 3.1, "c": 100.5}', "7", '"2.5"', "[]", deep]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, j string").select("id", F.expr("parse_json(j)").alias("p"))
    found = N.payload_markets(df, ["id"], "p").drop("margin")
    got = sorted(map(tuple, found.collect()))
    three = ("a", "b", "c", 2.5, 3.1, 3.3)
    assert (0, "", *three) in got and (7, "[0]" * 300 + ".z", *three) in got and (1, "x[1][0]", "p", "q", "r", 1.9, 3.0, 5.0) in got
    assert {r[0] for r in got} == {0, 1, 7} and not any({"d", "e", "g"} & set(r[2:5]) for r in got if r[0] == 0)
    assert got == sorted(map(tuple, N.market_triples(N.walk(df, ["id"], "p"), ["id", "path"]).drop("margin").collect()))
