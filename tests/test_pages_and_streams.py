import json

import pytest
from pyspark.sql import functions as F

from poolspark.functions import nested as N
from poolspark.operators import audit as A
from poolspark.operators import ingest as I
from poolspark.operators import matching as J
from poolspark.operators import pages as H
from poolspark.sources import readers as R
from poolspark.sources import writers as W
from poolspark.streaming import frames as X
from poolspark.streaming import runs as S


def tag(name, body, **attributes):
    return "<" + name + "".join(f' {k.replace("_", "-").strip("-")}="{v}"' for k, v in attributes.items()) + f">{body}</{name}>"


def cells(*values):
    return "".join(tag("td", v) for v in values)


def settled_page(n, winner=None, reports=(), head="Vendredi à 20h10"):
    """An archive page of ``n`` matches whose ``winner``-th outcome is marked, with its payout rows."""
    lines = [tag("tr", tag("td", head, _class="head"))]
    for i in range(n):
        spans = "".join(tag("span", sign, _class="res" if k == winner else "") for k, sign in enumerate("1N2"))
        lines.append(tag("tr", tag("td", f"Hôte &amp; Co {i}", _class="home") + tag("td", spans, _class="result") + tag("td", f"Visiteur {i}", _class="ext")))
    paid = tag("table", "".join(tag("tr", cells(rank, f"{count:,}".replace(",", " "), f"{amount:.2f}".replace(".", ",") + "&nbsp;&euro;"))
                                for rank, count, amount in reports)) if reports else ""
    return tag("table", "".join(lines)) + paid


def pages(spark, *html):
    return spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id int, html string")


@pytest.mark.parametrize("n", [1, 9])
def test_archive_page(spark, n):
    reports = [(n, 4, 5120.75), (n - 1, 1262, 9.4)]
    got = {r.page_id: r for r in H.archive_page(pages(spark, settled_page(n, 0, reports), settled_page(n, 2), settled_page(n), "<p>rien</p>")).collect()}
    first = got[0]
    assert first.date == "Vendredi à 20h10" and first.reglee and set(got) == {0, 1, 2}
    assert [m.asDict() for m in first.matchs] == [{"home": f"Hôte & Co {i}", "away": f"Visiteur {i}", "issue": "1"} for i in range(n)]
    assert [tuple(r) for r in first.rapports] == reports
    assert {m.issue for m in got[1].matchs} == {"2"} and not got[2].reglee and got[1].rapports == got[2].rapports == []


def price_line(home, away, prices, score, kickoff):
    quoted = "".join(tag("td", f"{100 / p:.0f}%" + tag("span", f"{p:.2f}".replace(".", ","), _class=f"dev_span_{sign}")) for p, sign in zip(prices, "1n2"))
    return tag("table", tag("tr", tag("td", tag("span", "-", data_date_utc=kickoff)) + tag("td", f"{home}-{away}", _class="match") + quoted
                            + tag("td", "-".join(map(str, score)))))


def crowd_list(*teams):
    return tag("ul", "".join(tag("li", tag("span", f"{h} - {a}", _class="team") + "12,5%") for h, a in teams), _class="repart")


def test_price_page_and_list(spark):
    priced, other = ("Lune", "Soleil"), ("Mars", "Vénus")
    prices, score, kickoff = [2.15, 3.05, 4.4], (3, 1), "2031-02-09 18:30:00"
    table, listed = price_line(*priced, prices, score, kickoff), crowd_list(other, priced)
    got = [r.lines for r in H.price_page(pages(spark, table, listed, listed + table)).orderBy("page_id").collect()]
    line = got[0][0]
    assert ((line.home, line.away), line.cotes, tuple(line.score), line.debut) == (priced, prices, score, kickoff)
    assert [(l.home, l.away, l.cotes) for l in got[1]] == [(*other, None), (*priced, None)]
    assert [(l.home, l.cotes is None) for l in got[2]] == [(other[0], True), (priced[0], False)]
    assert "public" not in line.asDict()


ROW = "struct<text:string,teams:array<string>,cell:string>"


def record(spark, body, rows):
    df = spark.createDataFrame([(body, rows, [("h", ["7", "2 gagnants", "1 234,50 €"])])],
                               f"body string, rows array<{ROW}>, report_rows array<struct<text:string,cells:array<string>>>")
    return H.page_record(df).first()


def test_page_rules(spark):
    played, cancelled, blank = ("A B 2 - 1", ["A", "B"], "2 - 1"), ("C D", ["C", "D"], "Annulé"), ("E F", ["E", "F"], "")
    r = record(spark, "Terminée. Montant distribué : 1 234,50 €", [played, cancelled, blank, ("x", ["G"], None)])
    assert r.statut == "terminee" and [m.resultat for m in r.matches] == ["1", "annule", "annule"]
    assert r.matches[2].annulation_deduite_de == "cellule vide" and r.matches[1].annulation_deduite_de is None
    assert r.montant_distribue == 1234.5 and r.lignes_ignorees[0].motif == "1 équipe(s) lue(s)"
    assert [tuple(x) for x in r.rapports] == [("7", 2, 1234.5)]
    assert record(spark, "en cours", [played]).statut is None
    assert record(spark, "match annulé hier, Terminée", [played]).mention_annulation is not None
    void = record(spark, "cette grille est annulée", [])
    assert void.statut == "annulee" and "annulee" in void.annulation_indice and void.matches == []
    only_blank = record(spark, "Terminée", [blank])
    assert only_blank.statut is None and len(only_blank.lignes_ignorees) == 1


def test_frames(spark):
    noise = ["3probe", "40", "42[]", '42["m",3]', '42["m",{"pools":{"7000001":null}}]', "42[broken"]
    body = '42["m",{"pools":{"7000001":{"poolId":7000001,"matches":[2,1]}},"matches":{"1":{"competitor1Name":"A"}}}]'
    late = '42["m",{"matches":{"2":{"competitor1Name":"B"}}}]'
    df = spark.createDataFrame(list(enumerate(noise + [body])), "seq int, body string")
    assert X.entries(df.where(f"seq < {len(noise)}")).count() == 0
    part = X.accumulate(X.entries(df, "body", "seq"))
    assert not X.completeness(part).first().complete and X.complete_pools(part).count() == 0
    whole = X.accumulate(X.entries(df.unionByName(spark.createDataFrame([(99, late)], "seq int, body string")), "body", "seq"))
    got = X.complete_pools(whole).first()
    assert [m.home for m in got.matches] == ["B", "A"] and got.pool_id == 1 and got.pool_type == 7


def test_pool_without_matches_is_incomplete(spark):
    df = spark.createDataFrame([(1, '42["m",{"pools":{"7000001":{"poolId":7000001,"matches":[]}}}]')], "seq int, body string")
    assert not X.completeness(X.accumulate(X.entries(df, "body", "seq"))).first().complete


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = [(k % 3, k % 7, k, *((1.0, 250.0, 250.0) if k % 4 == 1 else (None,) * 3 if k % 5 == 2 else (1.5 + k % 9, 3.0, 4.0))) for k in range(300)]
    schema = "pool_id int, match_id int, seq int, p1 double, px double, p2 double"
    df = spark.createDataFrame(rows, schema).withColumn("collected_at", F.timestamp_seconds("seq"))
    df.orderBy(F.hash("seq")).repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cols = ["pool_id", "match_id", "p1", "px", "p2", "observed_at", "collected_at"]
    batch = J.keep_last_plausible(df, ["pool_id", "match_id"], ["seq"]).select(*cols)
    got = S.keep_plausible(stream).select(*cols)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, batch.collect()))


def test_complete_pools_across_micro_batches(spark, tmp_path):
    bodies = ['42["m",{"pools":{"7000001":{"matches":[1,2]}}}]', '42["m",{"matches":{"1":{"competitor1Name":"A"}}}]',
              '42["m",{"matches":{"2":{"competitor1Name":"B"}},"pools":{"9000002":{"matches":[5]}}}]']
    for i, b in enumerate(bodies):
        spark.createDataFrame([(i, b)], "seq int, body string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq int, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert [r.global_id for r in S.emit_complete(stream).collect()] == [7000001]


def test_market_signature(spark):
    payload = {"matches": {"1": {"x": 1.9, "y": 3.6, "z": 4.2, "flag": True, "id": 7000001}, "2": {"a": 1.0, "b": 250, "c": 250}},
               "deep": [{"l": {"m": {"n": {"o": {"p": {"u": 2.5, "v": 3.1, "w": 2.9}}}}}}]}
    df = spark.createDataFrame([(1, json.dumps(payload))], "id int, j string").select("id", F.expr("parse_json(j)").alias("payload"))
    got = {r.path: (r.v1, r.v2, r.v3) for r in N.market_triples(N.walk(df, ["id"], "payload"), ["id", "path"]).collect()}
    assert got == {"matches.1": (1.9, 3.6, 4.2), "deep[0].l.m.n.o.p": (2.5, 3.1, 2.9)}


def test_walk_equals_plain_recursion(spark):
    def objects(value, path=""):
        if isinstance(value, dict):
            yield path, value
            for k, v in value.items():
                yield from objects(v, f"{path}.{k}" if path else k)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from objects(v, f"{path}[{i}]")

    deep = {"end": 1}
    for i in range(150):
        deep = {"n": deep} if i % 2 else [0, deep]
    bodies = [{}, [], None, 3, "text", {"a": None, "b": "", "c": [], "d": {}}, [1, {"x": [{"y": {}}, None, "z"]}, [[{"é.k": [True]}]]], {"": {"": {}}}, deep]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(99, None)], "id int, j string")
    rows = N.walk(df.select("id", F.expr("parse_json(j)").alias("object")), ["id"], "object")
    got = sorted((r.id, r.path, json.dumps(json.loads(r.j), sort_keys=True)) for r in rows.select("id", "path", F.to_json("object").alias("j")).collect())
    assert got == sorted((i, p, json.dumps(o, sort_keys=True)) for i, b in enumerate(bodies) for p, o in objects(b))


def test_key_inventory(spark):
    df = spark.createDataFrame([('{"a":1,"b":null,"c":0}',), ('{"a":"","b":[],"c":false}',)], "j string").select(F.expr("parse_json(j)").alias("object"))
    assert {r.key: (r.present, r.filled) for r in N.key_inventory(df).collect()} == {"a": (2, 1), "b": (2, 0), "c": (2, 2)}


def test_restricted_fields(spark):
    df = spark.createDataFrame([(1, [("A", [1.0]), ("B", [2.0]), ("C", None)])], "public_connu int, matchs array<struct<home:string,public:array<double>>>")
    once = N.drop_restricted(df)
    assert once.first().removed == 3 and "public_connu" not in once.columns and "public" not in once.schema["matchs"].dataType.elementType.names
    assert N.drop_restricted(once).first().removed == 0
    assert not N.publishable(df, N.residual())


def test_guards(spark):
    events = ["error"] * 4 + ["present"] + ["error"] + ["success"] + ["error"] * 2 + ["absent"] * 3 + ["error"] + ["absent"]
    log = spark.createDataFrame([("a", i, s) for i, s in enumerate(events)], "g string, id int, status string")
    pos = {r.id: r.position for r in I.consecutive(log, ["g"], "id", "status", "error", width=4, levels=1).collect()}
    assert pos[5] == 5 and pos[6] == 0 and pos[8] == 2 and pos[12] == 1
    breach = I.first_breach(I.consecutive(log, ["g"], "id", "status", "error"), ["g"], "id", I.STOP_ERRORS, "error").first()
    assert breach.stop_at == 5


def test_identical_payloads(spark):
    saved = spark.createDataFrame([("a", i, s) for i, s in enumerate(["x", "x", None, None, "y", "y", "y", "z"])], "g string, id int, sig string")
    pos = [r.position for r in I.repeated_payloads(saved, ["g"], "id", "sig").orderBy("id").collect()]
    assert pos == [1, 2, 1, 1, 1, 2, 3, 1]


def test_gaps(spark):
    ids = spark.createDataFrame([("t", i) for i in [1, 2, 5, 30, 31]], "t string, id long")
    runs = {r.first_missing: (r.length, r.hole) for r in A.gaps(ids, ["t"], "id", width=4, levels=2).collect()}
    assert runs == {3: (2, True), 6: (24, False)}
    assert {r.missing_id for r in A.missing_ids(A.gaps(ids, ["t"], "id"), ["t"]).collect()} == {3, 4}


def test_league_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("ï»¿Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,PSH,PSD,PSA\nE0,15/09/2015,Málaga,\"Real, B\",2,1,1.9,3.5,4.2\nE0,,X,Y,1,1,,,\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("Country,League,Season,Date,Home,Away,HG,AG\nBrazil,Serie A,2015,16/09/15,Santos,Gremio,,0\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"")
    got = {r.home_name: r for r in R.league_fixtures(spark, str(tmp_path)).collect()}
    assert set(got) == {"Málaga", "Santos"} and got["Málaga"].away_name == "Real, B" and got["Málaga"].prices["pinnacle"].px == 3.5
    assert got["Santos"].competition == "Brazil · Serie A" and got["Santos"].goals_home is None and str(got["Santos"].match_date) == "2015-09-16"


def test_page_pool_scan_keeps_unreadable_files(spark, tmp_path):
    good = {"grille_id": 5, "grille_type": "grille7", "statut": "terminee", "matches": [], "rapports": []}
    (tmp_path / "5.json").write_text(json.dumps(good))
    (tmp_path / "6.json").write_text("{broken")
    pools, bad = R.page_pools(spark, str(tmp_path))
    assert [r.grille_id for r in pools.collect()] == [5] and bad.count() == 1
    assert {r.what for r in A.anomalies(pools).collect()} == {"terminée mais sans rapports ni montant"}


def test_absent_lookup_is_empty_and_dates_keep_other_types(spark, tmp_path):
    path = str(tmp_path / "dates")
    schema = "pool_id long, day string, pool_type int"
    assert R.lookup(spark, path, schema).count() == 0
    W.write_dates(spark.createDataFrame([(1, "a", 7), (2, "b", 9)], schema), path)
    W.write_dates(spark.createDataFrame([(3, "c", 9)], schema), path)
    assert {(r.pool_id, r.pool_type) for r in R.lookup(spark, path, schema).collect()} == {(1, 7), (3, 9)}


def test_slip_lines(spark, tmp_path):
    W.write_slips(spark.createDataFrame([([0, 1, 2],)], "picks array<int>"), str(tmp_path / "slips"))
    assert [r.value for r in spark.read.text(str(tmp_path / "slips")).collect()] == ["1N2"]


@pytest.mark.parametrize("name", ["banded_return", "strict_fixture_match", "published_index", "id_gaps", "frames_completeness"])
def test_registered_queries_agree_with_their_sql(spark, name):
    import duckdb

    from poolspark.plans import load
    from tools.check import TABLES, compare

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, oracles = load()
    text, _, fine = compare(spark, con, name, queries[name], oracles[name], sf)
    assert fine, text


def test_no_forbidden_shortcuts():
    import pathlib

    from poolspark.plans import load

    queries, oracles = load()
    assert set(oracles) <= set(queries)
    source = "\n".join(p.read_text() for p in pathlib.Path(__file__).resolve().parent.parent.joinpath("poolspark").rglob("*.py"))
    assert "local" + "Checkpoint" not in source and ".cross" + "Join(" not in source


def test_headers_beyond_the_reach_are_reported(spark):
    head = lambda *names: "".join(f'<th class="wdtheader">{n}</th>' for n in names)
    token = lambda n: f'<input name="wdtNonceFrontendServerSide_{n}" value="t{n}">'
    far = f'<div data-wpdatatable_id="1">{head("H", "D")}{"." * 300}{head("A", "B")}</div>'
    near = f'<div data-wpdatatable_id="2">{head("FTHG", "FTAG")}</div>{token(1)}{token(2)}'
    pages = spark.createDataFrame([(1, far + near), (2, near), (3, None), (4, "")], "page int, html string")
    assert [tuple(r) for r in H.cut_heads(pages, "html", "page", reach=200).collect()] == [(1, "1", 2, 2)]
    assert H.cut_heads(pages, "html", "page").count() == 0
    found = {reach: sorted((r.page, r.table_id, r.kind) for r in H.data_tables(pages, "html", "page", reach=reach).collect()) for reach in (200, 4000)}
    assert found[200] == [(1, "2", "scores"), (2, "2", "scores")] and found[4000] == [(1, "1", "cotes"), *found[200]]
