import unicodedata
from datetime import date

import pytest
from pyspark.sql import functions as F

from poolspark.functions import categories as C
from poolspark.functions import dates as D
from poolspark.functions import prices as P
from poolspark.functions import results as R
from poolspark.functions import text as T

def written(value, between, mark, unit=""):
    """A number as text: groups of three digits parted by ``between``, decimals after ``mark``."""
    whole, cents = f"{value:.2f}".split(".")
    groups = [whole[max(0, end - 3):end] for end in range(len(whole), 0, -3)][::-1]
    return between.join(groups) + mark + cents + unit


VALUES = [0.0, 7.5, 962.04, 81406.25, 5720913.38]
AMOUNTS = [(written(v, *style), v) for v in VALUES for style in
           [*((space, ",", unit) for space in [*T.AMOUNT_SPACES, ""] for unit in (" €", "", " EUR")), (".", ",", " €"), (",", ".", ""), ("", ".", "")]]
AMOUNTS += [(str(n), float(n)) for n in (0, 3, 408)] + [("7,125", 7.125)] + [(nothing, None) for nothing in ("", None, "inconnu", "€")]

GOALS = [(0, 0), (4, 1), (13, 20)]
BLANK_SCORES = [None, "", "remis", "21 - 4", "4 - 21", "100 - 2"]


def score_texts():
    """(text, score): one plausible score in different surroundings, and texts that hold none or two."""
    for h, a in GOALS:
        for dash in ("-", "–"):
            for front, back in (("", ""), ("Hôtes ", " Visiteurs"), ("le 4 à 20:45, Hôtes ", " Visiteurs"), ("Hôtes1N2Visiteurs", "")):
                yield f"{front}{h} {dash} {a}{back}", (h, a)
        yield f"Hôtes {h} - {a} Visiteurs, pause {h} - 0", None
    for text in BLANK_SCORES:
        yield text, None


SCORES = list(score_texts())


def test_amounts(spark):
    rows = spark.createDataFrame([(t, v) for t, v in AMOUNTS], "t string, v double")
    assert all(r.got == r.v for r in rows.select("v", T.parse_amount("t").alias("got")).collect())


def test_scores(spark):
    rows = spark.createDataFrame([(t, *(s or (None, None))) for t, s in SCORES], "t string, h int, a int")
    for r in rows.select("*", T.extract_score("t").alias("s")).collect():
        assert (tuple(r.s) if r.s else (None, None)) == (r.h, r.a), r.t


def test_score_ceiling_depends_on_the_source(one):
    assert one(T.extract_score("t"), t="29 - 52") is None
    assert tuple(one(T.extract_score("t", T.MAX_GOALS_CELL), t="29 - 52")) == (29, 52)


def test_fold(spark):
    rows = spark.createDataFrame([(x,) for x in ("Saint-Étienne", "saint etienne", None, "Malmö FF", "Brøndby", "Łódź")], "n string")
    assert [r.f for r in rows.select(T.fold("n").alias("f")).collect()] == [
        "saintetienne", "saintetienne", "", "malmoff", "brndby", "odz"]


def test_tokens_and_same_team(one):
    assert sorted(one(T.tokens("n"), n="FC Saint-Étienne de Loire")) == ["etienne", "loire", "saint"]
    assert one(T.same_team(F.lit("Atl. Madrid"), F.lit("Atletico Madrid")))
    assert one(T.same_team(F.lit("OFI Crète"), F.lit("OFI Crete")))
    assert not one(T.same_team(F.lit("Marseille"), F.lit("Atl. Madrid")))
    assert one(T.same_team(F.lit("PSG"), F.lit("Marseille")))


@pytest.mark.parametrize("trio,fine", [((250.0, 250.0, 1.0), False), ((1.06, 12.0, 30.0), True), ((1.04, 8.0, 30.0), False),
                                       ((1.5, 8.0, 150.0), False), ((1.5, None, 3.0), False), ((1.5, 4.0, 100.0), True)])
def test_plausible_market(one, trio, fine):
    assert one(P.plausible_market(*[F.lit(x).cast("double") for x in trio])) is fine


def test_decode_reads_the_code_backwards(one):
    got = one(R.decode_result("c", F.lit(7)), c="100001100100100100111")
    assert got == [["1", "N", "2"], ["1"], ["1"], ["1"], ["1"], ["2"], ["1"]]
    assert one(R.decode_result("c", F.lit(2)), c="000100") == [["1"], None]
    assert one(R.decode_result("c", F.lit(2)), c="1001") == [None, None]


def test_repeated_rank_keeps_the_last(spark):
    rows = spark.sql("select array(named_struct('rank', 7, 'winners', 1L, 'amount', 5D), named_struct('rank', 6, 'winners', 2L, "
                     "'amount', cast(null as double)), named_struct('rank', 7, 'winners', 9L, 'amount', 8D)) p")
    amounts, winners = R.payout_maps("p")
    r = rows.select(amounts.alias("a"), winners.alias("w")).first()
    assert r.a == {6: 0.0, 7: 8.0} and r.w == {6: 2, 7: 9}


def test_histogram_mean(spark):
    assert spark.sql("select array(1L, 0L, 1L) h").select(R.histogram_mean("h", F.lit(2)).alias("x")).first().x == 0.5


def test_preferred_price_and_cutoff(spark):
    rows = spark.sql("select map('pinnacle', named_struct('p1', 2D, 'px', 3D, 'p2', 4D), 'bet365', named_struct('p1', 2.1D, 'px', 3D, 'p2', 4D)) m")
    pick = lambda day: rows.select(P.preferred_price(F.col("m"), F.lit(day).cast("date")).alias("x")).first().x
    assert pick("2025-06-30").source == "pinnacle" and pick("2025-07-01").source == "bet365"
    only = rows.select(F.map_filter("m", lambda k, v: k == "pinnacle").alias("m"))
    assert only.select(P.preferred_price(F.col("m"), F.lit("2025-07-01").cast("date")).alias("x")).first().x is None


def test_ratio_rounds_like_the_exact_value(spark):
    pairs = [(719.12, 320), (6166.32, 320), (6179.18, 304), (1.0, 3), (0.0, 5), (5.0, 0), (2.5, 20000), (None, 3)]
    rows = spark.createDataFrame(pairs, "d double, s long").select("d", "s", P.payout_ratio("d", "s").alias("r")).collect()
    for r in rows:
        assert r.r == (round(r.d / r.s, 4) if r.d and r.s else None), r


def test_source_letters(spark):
    rows = spark.createDataFrame([("winamax",), ("bet365_cloture",), ("autre",)], "s string")
    assert [r.x for r in rows.select(P.source_letter("s").alias("x")).collect()] == ["w", "b", None]


def test_dates(spark):
    rows = spark.createDataFrame([("15/09/2015", "15-09-15 20:45"), ("15/09/15", "15-09-15"), ("x", None)], "a string, b string")
    got = rows.select(D.parse_league_date("a").alias("a"), D.parse_cup_date("b").alias("b")).collect()
    assert [r.a for r in got] == [date(2015, 9, 15), date(2015, 9, 15), None]
    assert [r.b for r in got] == [date(2015, 9, 15), None, None]


def test_season_floor(spark):
    rows = spark.createDataFrame([("/l/2014-2015/2015-grille-97/",), ("/l/2015-2016/2015-grille-97/",), ("/l/2026-grille-104/",)], "u string")
    assert [r.x for r in rows.select(T.too_old("u", F.lit("2015-2016")).alias("x")).collect()] == [True, False, False]
    assert not any(r.x for r in rows.select(T.too_old("u", F.lit("")).alias("x")).collect())
    assert [r.x for r in rows.select(T.archive_key("u").alias("x")).collect()] == ["2015-0097", "2015-0097", "2026-0104"]


@pytest.mark.parametrize("code,name", [("E0", "top 5"), ("Champions League", "coupe d'Europe"), ("E1", "deuxième division"),
                                       ("N1", "autre championnat européen"), ("World Cup 2022", "Coupe du monde"),
                                       ("Copa Libertadores", "Copa Libertadores"), ("BRA · Serie A", "autre championnat"), ("", None)])
def test_family(one, code, name):
    assert one(C.family("c"), c=code) == name


@pytest.mark.parametrize("families,n,genre", [
    (["top 5"] * 7, 7, "top 5"), (["top 5"] * 4, 7, "indéterminée"), ([], 7, "indéterminée"),
    (["top 5"] * 6 + ["coupe d'Europe"], 7, "coupes"), (["top 5"] * 6 + ["autre championnat"], 7, "autres championnats"),
    (["deuxième division"] * 7, 7, "autres championnats"), (["Coupe du monde"] + ["top 5"] * 5, 7, "coupes")])
def test_genre(spark, families, n, genre):
    row = spark.createDataFrame([(families, n)], "f array<string>, n int")
    assert row.select(C.genre(F.col("f"), F.col("n")).alias("x")).first().x == genre


def test_competition_name(spark):
    rows = spark.createDataFrame([(" E0 ", "X", "Y"), (None, "Brazil", "Serie A"), (None, None, "Serie A"), (None, "Brazil", None)], "d string, c string, l string")
    assert [r.x for r in rows.select(C.competition("d", "c", "l").alias("x")).collect()] == ["E0", "Brazil · Serie A", "Serie A", None]


def test_combo_retention(spark):
    legs = [{"p1": 3 / 1.14, "px": 3 / 1.14, "p2": 3 / 1.14}] * 7
    row = spark.createDataFrame([(legs,)], "m array<struct<p1:double,px:double,p2:double>>")
    assert row.select(P.combo_retention(F.col("m")).alias("x")).first().x == pytest.approx((1 / 1.14) ** 7)


@pytest.mark.parametrize("text", ["Équipe", "Ñandú à l'été", "Việt Nam", "ǘ ế", "plain", "", "é́", "́x", "Ångström"])
def test_composition_equals_the_canonical_one(one, text):
    apart = unicodedata.normalize("NFD", text)
    assert one(T.compose("x"), x=apart) == unicodedata.normalize("NFC", text)
    assert one(T.compose(T.decompose("x")), x=unicodedata.normalize("NFC", text)) == unicodedata.normalize("NFC", text)
