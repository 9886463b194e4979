import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from poolspark.operators import dating as D
from poolspark.operators import entity as E
from poolspark.operators import matching as J

FIXTURE = "home_name string, away_name string, match_date date, goals_home int, goals_away int, competition string"


def fixtures(spark, rows):
    df = spark.createDataFrame(rows, FIXTURE).withColumn("prices", F.expr(
        "map('pinnacle', named_struct('p1', 2D, 'px', 3.4D, 'p2', 4D))"))
    return J.with_team_keys(df, home="home_name", away="away_name")


D0 = date(2020, 5, 10)
CASES = [  # fixtures, match (home, away, day, score), reason
    ([("Lens", "Lille", D0, 2, 1, "F1")], ("Lens", "Lille", D0, 2, 1), None),
    ([("Lens", "Lille", date(2020, 5, 11), 2, 1, "F1")], ("Lens", "Lille", D0, 2, 1), None),
    ([("Lens", "Lille", date(2020, 5, 12), 2, 1, "F1")], ("Lens", "Lille", D0, 2, 1), J.ABSENT),
    ([("Lens", "Lille", D0, 2, 2, "F1")], ("Lens", "Lille", D0, 2, 1), J.SCORES_DIFFER),
    ([("Lens", "Lille", D0, 2, 1, "F1"), ("Lens", "Lille", date(2020, 5, 9), 0, 0, "F1")], ("Lens", "Lille", D0, 2, 1), J.SEVERAL),
    ([("Lille", "Lens", D0, 1, 2, "F1")], ("Lens", "Lille", D0, 2, 1), J.ABSENT),
    ([("Lens", "Lille", D0, None, None, "F1")], ("Lens", "Lille", D0, 2, 1), None),
    ([("Lens", "Lille", date(2020, 5, 11), None, None, "F1")], ("Lens", "Lille", D0, 2, 1), J.SHIFTED),
    ([("Lens", "Lille", D0, 2, 1, "F1")], ("Lens", "Lille", None, 2, 1), J.NO_DATE),
    ([("Lens", "Lille", D0, 2, 1, "F1")], ("LENS", "lille", D0, None, None), None),
]


@pytest.mark.parametrize("known,match,reason", CASES)
def test_strict_match(spark, known, match, reason):
    rows = J.with_team_keys(spark.createDataFrame([match], "home string, away string, day date, score_home int, score_away int"))
    got = J.strict_match(rows, fixtures(spark, known)).first()
    assert got.reason == reason and (got.found is None) == (reason is not None)


def test_own_price_first_then_the_fixture(spark):
    rows = spark.createDataFrame([
        (1, 1, 0, "Lens", "Lille", D0, 2, 1, 1.5, 4.0, 7.0), (2, 1, 1, "Lens", "Lille", D0, 2, 1, 1.0, 250.0, 250.0),
        (2, 2, 0, "Lens", "Lille", D0, 2, 1, 1.9, 4.0, 7.0), (3, 1, 2, "Metz", "Brest", D0, 2, 1, None, None, None)],
        "match_id long, pool_id long, ord int, home string, away string, day date, score_home int, score_away int, p1 double, px double, p2 double")
    got = {r.match_id: r for r in J.attach_prices(rows, fixtures(spark, [("Lens", "Lille", D0, 2, 1, "F1")]), ["pool_id", "ord"],
                                                  own_source="own").collect()}
    assert got[1].source == "own" and got[1].p1 == 1.5
    assert got[2].source == "pinnacle" and got[2].own_rejected and got[2].division == "F1"
    assert got[3].reason == J.ABSENT and got[3].p1 is None


def test_keep_last_plausible(spark):
    t = lambda d: datetime(2020, 1, d)
    rows = spark.createDataFrame([
        (1, t(1), 1.7, 4.1, 4.1), (1, t(2), None, None, None), (2, t(1), 1.9, 3.5, 4.0), (2, t(2), 1.0, 250.0, 250.0),
        (3, t(1), 2.0, 3.0, 3.5), (3, t(2), 2.2, 3.0, 3.3)], "m long, collected_at timestamp, p1 double, px double, p2 double")
    got = {r.m: r for r in J.keep_last_plausible(rows, ["m"], ["collected_at"]).collect()}
    assert (got[1].p1, got[1].observed_at) == (1.7, t(1))
    assert (got[2].p1, got[2].observed_at) == (1.9, t(1))
    assert (got[3].p1, got[3].observed_at) == (2.2, None)


def _archive(spark, matches, lines):
    return spark.createDataFrame([(matches, lines)], "matches array<struct<home:string,away:string,issue:string>>, "
                                 "lines array<struct<home:string,away:string,cotes:array<double>,score:array<int>,debut:string>>")


def test_enrichment_gates(spark):
    two = [("Atl. Madrid", "Malaga", "1"), ("Celtic", "Lask Linz", "1")]
    other = [("Marseille", "Strasbourg", [1.7, 4.2, 4.4], None, None), ("Sochaux", "Guingamp", [3.0, 3.2, 2.3], None, None)]
    got = J.enrich_archive(_archive(spark, two, other)).first()
    assert got.status == "affiches différentes (0/2)" and got.matches[0].cotes is None
    one = [("Lens", "Paris SG", "1")]
    assert J.enrich_archive(_archive(spark, one, [("Lens", "Paris SG", [1.9, 3.5, 4.0], [2, 0], None)])).first().status == "ok"
    assert J.enrich_archive(_archive(spark, one, [("Lens", "Paris SG", [1.9, 3.5, 4.0], [0, 2], None)])).first().status == J.OUTCOMES_DIFFER
    assert J.enrich_archive(_archive(spark, one, [])).first().status == J.NO_LINES
    assert J.enrich_archive(_archive(spark, two, other[:1])).first().status == J.LENGTH_DIFFERS


def _anchor_inputs(spark, pools, known):
    rows = J.with_team_keys(spark.createDataFrame([(7, p, i, h, a) for p, ms in pools for i, (h, a) in enumerate(ms)],
                                                  "pool_type int, pool_id long, ord int, home string, away string"))
    fx = J.with_team_keys(spark.createDataFrame(known, "home_name string, away_name string, match_date date"), home="home_name", away="away_name")
    return rows, fx


def test_anchor_day(spark):
    rows, fx = _anchor_inputs(spark, [(1, [("A", "B"), ("C", "D"), ("E", "F")])], [
        ("A", "B", date(2020, 1, 1)), ("A", "B", date(2019, 1, 1)), ("C", "D", date(2020, 1, 3)), ("E", "F", date(2020, 1, 4)),
        ("E", "F", date(2020, 1, 2))])
    got = D.anchors(rows, fx, 2).first()
    assert (got.day, got.n) == (date(2020, 1, 1), 3)


def test_admission_and_manual_anchor(spark):
    schema = "pool_type int, pool_id long, day date, n long"
    sure = spark.createDataFrame([(7, 10, date(2020, 1, 1), 3), (7, 30, date(2020, 2, 1), 3)], schema)
    extra = spark.createDataFrame([(7, 20, date(2020, 1, 15), 2), (7, 25, date(2015, 1, 1), 2), (7, 40, date(2020, 3, 1), 2)], schema)
    got = {r.pool_id: r.verdict for r in D.admit(sure, extra).collect()}
    assert got == {10: "squelette", 20: "admise", 25: "refusée", 30: "squelette", 40: None}
    hand = spark.createDataFrame([(7, 10, date(2020, 1, 2))], "pool_type int, pool_id long, day date")
    merged, conflicts = D.with_manual(sure, hand, ["pool_type", "pool_id"])
    assert {r.pool_id: r.n for r in merged.collect()} == {10: 99, 30: 3} and conflicts.count() == 1


def test_interpolation(spark):
    anchored = spark.createDataFrame([(7, 10, date(2020, 1, 1), 3), (7, 20, date(2020, 1, 11), 3)], "pool_type int, pool_id long, day date, n long")
    pools = spark.createDataFrame([(7, i) for i in (5, 10, 15, 20, 25)], "pool_type int, pool_id long")
    got = {r.pool_id: r for r in D.interpolate(anchored, pools).collect()}
    assert got[15].date == date(2020, 1, 6) and got[15].uncertainty == 10 and got[15].source == "interpolation"
    assert got[5].date is None and got[5].date_min is None and got[5].date_max == date(2020, 1, 1)
    assert got[25].date is None and got[25].date_min == date(2020, 1, 11) and got[25].date_max is None


def test_candidates_equal_brute_force(spark):
    import random
    import unicodedata
    from difflib import SequenceMatcher

    from poolspark.functions.text import CLUB_WORDS

    rnd = random.Random(2)
    parts = ["real", "fc", "madrid", "saint", "étienne", "united", "malmö", "sporting", "rovers", "inter", "vitesse", "brest"]
    known = list(dict.fromkeys(" ".join(rnd.sample(parts, rnd.choice([1, 2, 3]))) for _ in range(150)))
    names = list(dict.fromkeys("".join(c for c in " ".join(rnd.sample(parts, 2)) if rnd.random() > 0.15) for _ in range(25)))
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn").lower()
    words = lambda s: set(plain(s).replace("-", " ").split()) - set(CLUB_WORDS)
    expected = {}
    for n in names:
        scored = []
        for i, k in enumerate(known):
            shared, ratio = bool(words(n) & words(k)), SequenceMatcher(None, plain(n), plain(k)).ratio()
            if shared or ratio >= 0.55:
                scored.append((-(ratio + (0.3 if shared else 0)), i, k))
        expected[n] = [k for _, _, k in sorted(scored)[:12]]
    dictionary = spark.createDataFrame([(f"k{i}", k, (i,)) for i, k in enumerate(known)], "folded string, display string, first struct<i:int>")
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    for chunk in (2000, 40):
        rows = E.name_candidates(frame, dictionary, chunk=chunk).orderBy("name", "rank").collect()
        got = {n: [r.display for r in rows if r.name == n] for n in names}
        assert got == expected


def test_longest_common_subsequences():
    import random

    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdé ") for _ in range(rnd.choice([0, 1, 7, 40, 63, 64]))) for _ in range(60)]
    alphabet = {c: i for i, c in enumerate(sorted(set("".join(texts))))}
    for target in ["", "a", "é b", texts[3], texts[7][::-1], "abcd" * 30]:
        got = E._common_subsequences(E._places(texts, alphabet), [alphabet[c] for c in target if c in alphabet])
        for text, n in zip(texts, got.tolist()):
            row = [0] * (len(text) + 1)
            for c in target:
                last = 0
                for i, d in enumerate(text):
                    last, row[i + 1] = row[i + 1], last + 1 if c == d else max(row[i + 1], row[i])
            assert n == row[-1]


def test_candidates_of_odd_names_equal_brute_force(spark):
    from difflib import SequenceMatcher

    known = ["", "a", "x" * 64, "x" * 65, "real " * 20, "real madrid", "réal-madrid", "a\0b", "b a", "zzz", "ab " * 90]
    names = ["", "a", "x" * 63 + "y", "x" * 70, "real", "madrid real", "a\0b", "ab " * 88 + "c"]
    plain = lambda t: t.replace("é", "e").lower()
    words = lambda t: set(plain(t).replace("-", " ").split())
    expected = {}
    for n in names:
        scored = [(-(SequenceMatcher(None, plain(n), plain(k)).ratio() + 0.3 * bool(words(n) & words(k))), i) for i, k in enumerate(known)
                  if words(n) & words(k) or SequenceMatcher(None, plain(n), plain(k)).ratio() >= 0.55]
        expected[n] = [i for _, i in sorted(scored)[:12]]
    dictionary = spark.createDataFrame([(f"k{i}", k, (i,)) for i, k in enumerate(known)], "folded string, display string, first struct<i:int>")
    rows = E.name_candidates(spark.createDataFrame([(n,) for n in names], "name string"), dictionary).orderBy("name", "rank").collect()
    assert {n: [int(r.folded[1:]) for r in rows if r.name == n] for n in names} == expected


def _day(spark, matches, known):
    rows = spark.createDataFrame(matches, "home string, away string, day date, score_home int, score_away int")
    return rows, fixtures(spark, known)


def test_exact_day_inference(spark):
    d = [date(2020, 1, i) for i in range(1, 8)]
    rows, fx = _day(spark, [("Schalke", "Mayence", d[0], 2, 1), ("Schalke", "Mayence", d[1], 0, 0), ("Schalke", "Cologne", d[2], 1, 1)],
                    [("Schalke", "Mainz", d[0], 2, 1, "D1"), ("Schalke", "Mainz", d[1], 0, 0, "D1"), ("Schalke", "Koln", d[2], 1, 0, "D1")])
    got = {r.name: r for r in E.elect_by_day(E.exact_day_votes(rows, fx)).collect()}
    assert got["Mayence"].target == "mainz" and got["Mayence"].accepted and "Cologne" not in got


def test_lead_over_the_runner_up(spark):
    votes = spark.createDataFrame([("a", 9, "x", 2), ("a", 9, "y", 2), ("b", 9, "x", 2), ("b", 9, "y", 1), ("c", 9, "x", 3), ("c", 9, "y", 1),
                                   ("d", 9, "x", 1)], "name string, appearances long, target string, votes long")
    assert {r.name: r.accepted for r in E.elect_by_day(votes).collect()} == {"a": False, "b": False, "c": True, "d": False}


def test_fixpoint_unlocks_a_second_round(spark):
    d = [date(2020, 1, i) for i in range(1, 9)]
    # Round one names Beta through Known; round two names Gamma through Beta.
    rows, fx = _day(spark, [("Known", "Beta", d[0], 1, 0), ("Known", "Beta", d[1], 2, 0), ("Gamma", "Beta", d[2], 3, 0), ("Gamma", "Beta", d[3], 4, 0)],
                    [("Known", "B", d[0], 1, 0, "x"), ("Known", "B", d[1], 2, 0, "x"), ("G", "B", d[2], 3, 0, "x"), ("G", "B", d[3], 4, 0, "x")])
    got = {r.folded: (r.target, r.round) for r in E.alias_closure(rows, fx).collect()}
    assert got == {"beta": ("b", 1), "gamma": ("g", 2)}


def _closure(matches, known):
    """The rounds, match by match: {folded name: (target, confirmations, appearances, round)}."""
    fx = [(h.lower(), a.lower(), day, (x, y)) for h, a, day, x, y, _ in known]
    teams, pairs = {t for f in fx for t in f[:2]}, {f[:2] for f in fx}
    only = {}
    for h, a, day, score in fx:
        only.setdefault((h, day, "home"), []).append((a, score))
        only.setdefault((a, day, "away"), []).append((h, score))
    learnt, turn = {}, 0
    while True:
        turn += 1
        key = lambda x: learnt.get(x.lower(), (x.lower(),))[0]
        votes, seen = {}, {}
        for h, a, day, x, y in matches:
            if x is None or day is None or (key(h), key(a)) in pairs or (key(h) in teams) == (key(a) in teams):
                continue
            team, role, name = (key(h), "home", a) if key(h) in teams else (key(a), "away", h)
            seen[name] = seen.get(name, 0) + 1
            met = only.get((team, day, role), [])
            if len(met) == 1 and met[0][1] == (x, y):
                own = votes.setdefault(name, {})
                own[met[0][0]] = own.get(met[0][0], 0) + 1
        best = {}
        for name, own in votes.items():
            (target, n), *rest = sorted(own.items(), key=lambda v: (-v[1], v[0]))
            if n >= 2 and n >= 3 * (rest[0][1] if rest else 0):
                best[name.lower()] = max(best.get(name.lower(), (0, "", "")), (n, name, target))
        fresh = {f: (target, n, seen[name], turn) for f, (n, name, target) in best.items() if f not in learnt}
        if not fresh:
            return learnt
        learnt |= fresh


@pytest.mark.parametrize("seed", [1, 5])
def test_fixpoint_equals_plain_rounds(spark, seed):
    rng = random.Random(seed)
    teams = [(f"Team{i}", f"Team{i}" if i < 2 else f"Local{i}") for i in range(14)]
    known, matches = [], []
    for _ in range(330):
        i = rng.randrange(13)
        j = i + 1 if rng.random() < 0.97 else rng.randrange(14)  # mostly neighbours, so that names unlock one another
        if i == j:
            continue
        day, x, y = D0 + timedelta(days=rng.randrange(150)), rng.randrange(3), rng.randrange(3)
        known.append((teams[i][0], teams[j][0], day, x, y, "F1"))
        home, away = teams[i][1], teams[j][1]
        if rng.random() < 0.3:
            away = away.upper()  # another spelling that folds to the same
        if rng.random() < 0.2:
            x = rng.choice([None, 3])
        matches.append((home, away, rng.choice([day] * 12 + [None]), x, None if x is None else y))
    want = _closure(matches, known)
    got = {r.folded: (r.target, r.confirmations, r.appearances, r.round) for r in E.alias_closure(*_day(spark, matches, known)).collect()}
    assert got == want and max(v[3] for v in want.values()) >= 3 and len(want) >= 6


def test_window_confirmation(spark):
    matches = spark.createDataFrame([(i, "Barcelone", "Sevilla") for i in (1, 2, 3)], "pool_id long, home string, away string")
    dated = spark.createDataFrame([(1, D0, D0), (2, date(2020, 6, 10), date(2020, 6, 10)), (3, None, D0)], "pool_id long, date_min date, date_max date")
    fx = fixtures(spark, [("Barcelona", "Sevilla", date(2020, 5, 12), 1, 0, "x"), ("Barcelona", "Sevilla", date(2020, 6, 7), 1, 0, "x")])
    known = spark.createDataFrame([("barcelona",), ("sevilla",)], "folded string")
    context = E.contexts(matches, known, dated, ["pool_id"])
    cands = spark.createDataFrame([("Barcelone", "barcelona", "Barcelona", 1)], "name string, folded string, display string, rank int")
    got = E.elect_by_window(context, E.window_votes(context, cands, fx)).first()
    assert (got.target, got.confirmations, got.appearances, got.accepted) == ("barcelona", 2, 2, True)


def _twins(a, b):
    words = [[{w for w in re.split("[^a-z0-9]+", x.lower()) if len(w) >= 4} for x in line[:2]] for line in (a, b)]
    return all(p & q or not (p and q) for p, q in zip(*words))


def _completed(table, listing):
    """The rule, line by line: (home, away, ...)."""
    if len(listing) <= len(table):
        return table
    lines = list(table)
    for entry in listing:
        if not any(_twins(x, entry) for x in lines):
            lines.append(entry)
    place = {x[:2]: i for i, x in enumerate(listing)}
    return sorted(lines, key=lambda x: next((i for pair, i in place.items() if _twins(x, pair)), len(listing)))


def test_pools_with_repeated_teams_are_completed_too(spark, monkeypatch):
    from poolspark.plans import matching as plan, pages

    rng, pools = random.Random(2), {}
    for k in range(60):
        pools[k] = [(i + 1, "2020-01-%02d" % (i + 1), "Club %d" % rng.randrange(3), rng.choice([None, i]), 1, rng.choice([None, 1.5]), 2.5, 3.25, rng.randrange(6))
                    for i in range(rng.randint(3, 9))]
    matches = "array<struct<line:int,kickoff:string,away:string,score_home:int,score_away:int,p1:double,px:double,p2:double,part:int>>"
    frame = spark.createDataFrame(list(pools.items()), f"pool_id int, matches {matches}")
    monkeypatch.setattr(pages.V, "pools", lambda *_: frame)

    fuzzy, priced = {}, {}
    for k, rows in pools.items():
        bare = [(f"Equipe{m[8]}", m[2], "@=") for m in rows]
        full = [(h, a, f"@{m[1]} 13:55:00=" + ("x" if m[5] else "") + (f"{m[3]}:{m[4]}" if m[3] is not None else ""), m[5] and m[5] + m[6] * 2 + m[7] * 3)
                for m, (h, a, _) in zip(rows, bare)]
        fuzzy[k] = " · ".join(f"{h.replace('Equipe', 'Équipe ')}-{a}" for h, a, _ in _completed(bare[::2][::-1], bare))
        done = _completed([] if k % 6 == 0 else full[::2] if k % 6 == 1 else full, bare)
        priced[k] = (" | ".join(f"{x[0]}-{x[1]}{x[2]}" for x in done), sum(x[3] or 0 for x in done if len(x) > 3))
    assert {r.pool_id: r.lines for r in plan.fuzzy_completion(spark, "").collect()} == fuzzy
    assert {r.pool_id: (r.lines, r.price_sum) for r in pages.price_pages(spark, "").collect()} == priced


def test_anchor_days_equal_brute_force_with_a_hot_pair(spark):
    rnd = random.Random(3)
    day0 = date(2020, 1, 1)
    fixtures = [(h, a, day0 + timedelta(days=rnd.randrange(60))) for h in "abc" for a in "xyz" for _ in range(3)]
    fixtures += [("hot", "pair", day0 + timedelta(days=d)) for d in range(0, 1500, 2)] * 2
    matches = [(7, p, o, *(("hot", "pair") if rnd.random() < 0.4 else (rnd.choice("abc"), rnd.choice("xyz")))) for p in range(60) for o in range(5)]
    frame = spark.createDataFrame(matches, "pool_type int, pool_id long, ord int, home_key string, away_key string").repartition(3)
    known = spark.createDataFrame(fixtures, "home_key string, away_key string, match_date date")
    got = {r.pool_id: (r.day, r.n) for r in D.anchors(frame, known, 2).collect()}
    want = {}
    for p in range(60):
        own = [{f[2] for f in fixtures if f[:2] == m[3:]} for m in matches if m[1] == p]
        best = max(((sum(any(d + timedelta(days=k) in s for k in range(4)) for s in own), -(d - day0).days) for d in set().union(*own)), default=(0, 0))
        if best[0] >= 2:
            want[p] = (day0 - timedelta(days=best[1]), best[0])
    assert got == want
    assert D.anchors(frame, known.where("home_key = ''"), 2).count() == 0
