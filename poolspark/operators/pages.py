"""Extraction from archived pages held as rows; one narrow pass per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolspark.functions import results as R
from poolspark.functions import text as T
from poolspark.operators.matching import complete_lines

# The markup of the archive pages and of the table pages.
TABLE = r"(?s)<table.*?</table>"
ROW = r"(?s)<tr.*?</tr>"
ROW_ATTR = r"(?s)<tr[^>]*>.*?</tr>"
CELL = r"(?s)<td[^>]*>(.*?)</td>"
WHOLE_CELL = r"(?s)<td[^>]*>.*?</td>"
HEAD = r'(?s)class="head"[^>]*>(.*?)</t[dh]>'
HOME = r'(?s)class="home"[^>]*>(.*?)</td>'
AWAY = r'(?s)class="ext"[^>]*>(.*?)</td>'
RESULT = r'(?s)class="result"[^>]*>(.*?)</td>'
SPAN = r"(?s)<span([^>]*)>(.*?)</span>"
MATCH = r'(?s)class="match"[^>]*>(.*?)</td>'
PRICE = r'(?s)dev_span_%s"[^>]*>(.*?)</span>'
KICKOFF = r'data-date-utc="([^"]+)"'
ROW_SCORE = r">\s*(\d{1,2})\s*-\s*(\d{1,2})\s*<"
LIST = r'(?s)<ul class="repart">(.*?)</ul>'
ITEM = r"(?s)<li[^>]*>(.*?)</li>"
TEAM = r'(?s)class="team"[^>]*>(.*?)</span>'
DATATABLE = r'(?s)(?=(data-wpdatatable_id="\d+".{0,%d}))data-wpdatatable_id='
DATATABLE_OWN = r'^data-wpdatatable_id="\d+"'
DATATABLE_ID = r'data-wpdatatable_id="(\d+)"'
DATATABLE_HEADER = r"wdtheader[^>]*>\s*([A-Za-z0-9_ ]+?)</th>"
NONCE = r'name="wdtNonceFrontendServerSide_(\d+)" value="([^"]+)"'
PRICE_HEADERS, SCORE_HEADERS = ["H", "D", "A"], ["FTHG", "FTAG"]
AMOUNT_LINE = r"montant distribue\s*:?\s*([\d\s  .,]+)"
SETTLED_WORD, CANCEL_WORD = "terminee", "annul"
DISCARD_LENGTH, CONTEXT = 120, 60
# Fixed values, in characters: how far behind its id the headers of a table are read, how far before its end a row's score.
HEAD_REACH, SCORE_TAIL = 4000, 400


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when the pattern is absent."""
    return F.try_element_at(_all(text, pattern, group), F.lit(1))


def _teams(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, "-", 2)
    return F.trim(parts[0]), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def archive_page(pages: DataFrame, html: str = "html") -> DataFrame:
    """Archive page to pool: ``date, matchs, rapports, reglee``; a page without table gives no row.

    The winning outcome is the marked span, the last one when several are marked.
    """
    pages = pages.withColumn(html, T.compose(html))
    # Exploded, not filtered: a condition on the tables is moved below them and reads (and writes) the page again.
    tables = F.filter(F.array(_all(F.col(html), TABLE)), lambda t: F.size(t) > 0)
    base = pages.select("*", F.explode(tables).alias("__t")).withColumn("__r", _all(F.col("__t")[0], ROW))

    def line(row):
        def issue(cell):
            marks = F.arrays_zip(_all(cell, SPAN, 1).alias("attr"), _all(cell, SPAN, 2).alias("text"))
            wins = F.filter(F.transform(marks, lambda s, i: F.when(F.contains(s["attr"], F.lit("res")), F.when(
                i < 3, F.element_at(F.array(*[F.lit(o) for o in R.OUTCOMES]), F.least(i, F.lit(2)) + 1)).otherwise(
                T.clean_html_text(s["text"])))), lambda w: w.isNotNull())
            return F.try_element_at(wins, F.lit(-1))

        return F.struct(T.clean_html_text(_first(row, HOME)).alias("home"), T.clean_html_text(_first(row, AWAY)).alias("away"),
                        T.held(_first(row, RESULT), issue).alias("issue"))

    played = F.filter("__r", lambda r: r.rlike(HOME) & r.rlike(AWAY))
    heads = F.filter(F.transform("__r", lambda r: _first(r, HEAD)), lambda h: h.isNotNull())

    def reports(table):
        return T.held(F.transform(_all(table, CELL, 1), T.clean_html_text), paid)

    def paid(cells):
        starts = F.when(F.size(cells) >= 3, F.sequence(F.lit(0), F.size(cells) - 3, F.lit(3))).otherwise(
            F.array().cast("array<int>"))
        rows = F.transform(starts, lambda i: F.struct(
            F.get(cells, i).alias("rank"), F.replace(F.get(cells, i + 1), F.lit(" "), F.lit("")).alias("winners"),
            F.get(cells, i + 2).alias("amount")))
        return F.transform(F.filter(rows, lambda r: r["rank"].rlike(r"^\d+$") & r["winners"].rlike(r"^\d+$")), lambda r: F.struct(
            r["rank"].cast("int").alias("bons"), r["winners"].cast("long").alias("gagnants"),
            T.parse_amount_simple(r["amount"]).alias("rapport")))

    options = F.filter(F.transform(F.slice("__t", 2, 2), reports), lambda x: F.size(x) > 0)
    return (base.withColumn("date", T.clean_html_text(F.try_element_at(heads, F.lit(1))))
            .withColumn("matchs", F.transform(played, line))
            .withColumn("rapports", F.coalesce(F.try_element_at(options, F.lit(1)), F.array().cast(
                "array<struct<bons:int,gagnants:bigint,rapport:double>>")))
            .withColumn("reglee", (F.size("matchs") > 0) & F.forall("matchs", lambda m: F.coalesce(m["issue"] != "", F.lit(False))))
            .drop("__t", "__r"))


def _listing(html: Column) -> Column:
    """Fixtures of the second block; the shares of the crowd next to them are not read."""
    items = F.filter(_all(_first(html, LIST), ITEM, 1), lambda i: i.rlike(TEAM))

    def line(item):
        home, away = _teams(T.clean_html_text(_first(item, TEAM)))
        return F.struct(home.alias("home"), away.alias("away"), F.lit(None).cast("string").alias("debut"),
                        F.lit(None).cast("array<double>").alias("cotes"), F.lit(None).cast("array<int>").alias("score"))

    return F.coalesce(F.transform(items, line), F.array().cast(
        "array<struct<home:string,away:string,debut:string,cotes:array<double>,score:array<int>>>"))


def price_page(pages: DataFrame, html: str = "html", out: str = "lines") -> DataFrame:
    """Price page to lines in list order: teams, kickoff, three prices or none, score.

    The cell class names the outcome. The fixture list completes a table that misses rows.
    """
    pages = pages.withColumn(html, T.compose(html))
    tables = _all(F.col(html), TABLE)
    rows = F.filter(_all(F.try_element_at(tables, F.lit(-1)), ROW_ATTR), lambda r: r.rlike(MATCH))

    def price(cells, sign):
        cell = F.try_element_at(F.filter(cells, lambda c: F.contains(c, F.lit(f'dev_span_{sign}"'))), F.lit(1))
        return T.parse_amount_simple(_first(cell, PRICE % sign))

    def trio(cells):
        prices = F.array(*[price(cells, s) for s in ("1", "n", "2")])
        return T.held(prices, lambda p: F.when(F.forall(p, lambda x: F.coalesce(x != 0, F.lit(False))), p))

    def score(tail):
        goals = F.array(_first(tail, ROW_SCORE, 1).cast("int"), _first(tail, ROW_SCORE, 2).cast("int"))
        return F.when(tail.rlike(ROW_SCORE), goals)

    def line(row):
        def named(text):
            home, away = _teams(text)
            return F.struct(home.alias("home"), away.alias("away"), _first(row, KICKOFF).alias("debut"),
                            T.held(_all(row, WHOLE_CELL), trio).alias("cotes"),
                            T.held(F.substring(row, -SCORE_TAIL, SCORE_TAIL), score).alias("score"))

        return T.held(T.clean_html_text(_first(row, MATCH)), named)

    empty = F.array().cast("array<struct<home:string,away:string,debut:string,cotes:array<double>,score:array<int>>>")
    staged = pages.withColumn("__table", F.coalesce(F.transform(rows, line), empty)).withColumn("__list", _listing(F.col(html)))
    return staged.withColumn(out, complete_lines(F.col("__table"), F.col("__list"))).drop("__table", "__list")


def data_tables(pages: DataFrame, html: str = "html", *keep: str, reach: int = HEAD_REACH) -> DataFrame:
    """Tables carrying prices or scores, by their headers and with their token: ``table_id, kind, headers, token``.

    Headers count up to ``reach`` characters from the id on; ``cut_heads`` reports the tables that have more behind.
    """
    chunks = F.explode(_all(F.col(html), DATATABLE % reach, 1)).alias("__c")
    nonce = F.arrays_zip(_all(F.col(html), NONCE, 1).alias("id"), _all(F.col(html), NONCE, 2).alias("token"))
    rows = pages.select(*keep, nonce.alias("__n"), chunks).withColumn("__c", F.substring("__c", 1, reach)).select(
        *keep, "__n", F.regexp_extract("__c", DATATABLE_ID, 1).alias("table_id"),
        F.transform(_all(F.col("__c"), DATATABLE_HEADER, 1), F.trim).alias("headers"))
    has = lambda names: F.size(F.array_except(F.array(*[F.lit(n) for n in names]), F.col("headers"))) == 0
    token = F.try_element_at(F.filter("__n", lambda n: n["id"] == F.col("table_id")), F.lit(1))["token"]
    return (rows.withColumn("kind", F.when(has(PRICE_HEADERS), "cotes").when(has(SCORE_HEADERS), "scores"))
            .withColumn("token", token).where("kind IS NOT NULL AND token IS NOT NULL").drop("__n"))


def cut_heads(pages: DataFrame, html: str = "html", *keep: str, reach: int = HEAD_REACH) -> DataFrame:
    """Tables with headers that ``data_tables`` does not read: ``table_id, read, beyond`` (numbers of headers).

    What stands up to the id of the next table belongs to a table.
    """
    own = F.filter(F.split(F.col(html), "(?=data-wpdatatable_id=)"), lambda c: c.rlike(DATATABLE_OWN))
    headers = lambda text: F.size(_all(text, DATATABLE_HEADER, 1))
    read = headers(F.substring("__c", 1, reach))
    return pages.select(*keep, F.explode(own).alias("__c")).select(
        *keep, F.regexp_extract("__c", DATATABLE_ID, 1).alias("table_id"), read.alias("read"),
        (headers(F.col("__c")) - read).alias("beyond")).where("beyond > 0")


def page_record(pages: DataFrame) -> DataFrame:
    """Row rules of a rendered page, from staged rows to the stored record.

    Input: ``body``, ``rows array<struct<text,teams array<string>,cell>>`` (``cell`` null when the row
    has no score cell) and ``report_rows array<struct<text,cells array<string>>>``. Output adds
    ``matches, rapports, lignes_ignorees, montant_distribue, statut, annulation_indice,
    mention_annulation``; pages that must not be stored have a null ``statut``.
    """
    plain = T.strip_accents("body")
    staged = pages.withColumn("__plain", plain).withColumn("__rows", F.transform("rows", _row))
    ok = F.filter("__rows", lambda r: r["kind"].isin("played", "cancelled"))
    doubt = F.filter("__rows", lambda r: r["kind"] == "doubtful")
    lost = F.filter("__rows", lambda r: r["kind"] == "discarded")
    as_match = lambda r: F.struct(
        r["home"].alias("home"), r["away"].alias("away"), r["score"]["home"].alias("score_home"),
        r["score"]["away"].alias("score_away"),
        F.when(r["kind"] == "played", R.outcome(r["score"]["home"], r["score"]["away"])).otherwise("annule").alias("resultat"),
        F.when(r["kind"] != "played", F.lit(True)).alias("tous_gagnants"),
        F.when(r["kind"] == "doubtful", F.coalesce(F.nullif(r["cell"], F.lit("")), F.lit("cellule vide"))).alias("annulation_deduite_de"))
    as_lost = lambda r: F.struct(r["ligne"].alias("ligne"), r["motif"].alias("motif"), r["texte"].alias("texte"))
    real = F.size(ok) > 0
    staged = staged.withColumn("matches", F.when(real, F.concat(F.transform(ok, as_match), F.transform(doubt, as_match)))
                               .otherwise(F.transform(ok, as_match)))
    staged = staged.withColumn("lignes_ignorees", F.concat(
        F.transform(lost, as_lost), F.when(~real, F.transform(doubt, lambda r: F.struct(
            r["ligne"].alias("ligne"), r["motif"].alias("motif"), r["texte"].alias("texte")))).otherwise(
            F.slice(F.transform(doubt, as_lost), 1, 0))))
    settled = F.contains("__plain", F.lit(SETTLED_WORD))
    mention = F.contains("__plain", F.lit(CANCEL_WORD))
    at = F.instr("__plain", CANCEL_WORD)
    start = F.greatest(at - 1 - CONTEXT, F.lit(0))
    around = F.substring(F.col("__plain"), start + 1, at - 1 + CONTEXT - start)
    hint = F.trim(F.regexp_replace(around, r"[\s\p{Z}]+", " "))
    some = F.size("matches") > 0
    explained = F.exists("matches", lambda m: m["resultat"] == "annule")
    status = F.when(some & settled, "terminee").when(~some & mention, "annulee")
    final = staged.withColumn("statut", status)
    void = F.coalesce(F.col("statut") == "annulee", F.lit(False))
    empty_matches, reports = F.slice("matches", 1, 0), _reports()
    return final.select(
        *[c for c in pages.columns if c not in ("body", "rows", "report_rows")], "statut",
        F.when(void, empty_matches).otherwise(F.col("matches")).alias("matches"),
        F.when(void, F.slice(reports, 1, 0)).otherwise(reports).alias("rapports"),
        F.when(~void, T.parse_amount(_first(F.col("__plain"), AMOUNT_LINE))).alias("montant_distribue"),
        F.when(void, hint).alias("annulation_indice"),
        F.when((F.col("statut") == "terminee") & mention & ~explained, hint).alias("mention_annulation"),
        F.when(~void & (F.size("lignes_ignorees") > 0), F.col("lignes_ignorees")).alias("lignes_ignorees"))


def _row(row, index) -> Column:
    """Classify one staged row: played, cancelled, doubtful (a cell without score) or discarded."""
    cell, text, teams = row["cell"], row["text"], row["teams"]
    cancelled = F.contains(T.strip_accents(F.coalesce(cell, text)), F.lit(CANCEL_WORD))
    score = F.coalesce(T.extract_score(cell, T.MAX_GOALS_CELL), T.extract_score(text, T.MAX_GOALS_TEXT))
    n = F.coalesce(F.size(teams), F.lit(0))
    kind = (F.when(n < 2, "discarded").when(cancelled, "cancelled").when(score.isNotNull(), "played")
            .when(cell.isNotNull(), "doubtful").otherwise("discarded"))
    home, away = F.trim(F.get(teams, F.lit(0))), F.trim(F.get(teams, F.lit(1)))
    motif = (F.when(n < 2, F.concat(n.cast("string"), F.lit(" équipe(s) lue(s)")))
             .when(cell.isNull(), F.lit("aucune cellule de score"))
             .otherwise(F.lit("cellule de score sans score lisible, et aucun score valide ailleurs sur la grille")))
    shown = F.when(cell.isNull() | (n < 2), text).otherwise(F.concat(home, F.lit(" - "), away, F.lit(" ['"), F.trim(cell), F.lit("']")))
    return F.struct(kind.alias("kind"), home.alias("home"), away.alias("away"), F.trim(cell).alias("cell"),
                    F.when((n >= 2) & ~cancelled, score).alias("score"), index.cast("int").alias("ligne"), motif.alias("motif"),
                    F.substring(shown, 1, DISCARD_LENGTH).alias("texte"))


def _reports() -> Column:
    rows = F.filter("report_rows", lambda r: (F.size(r["cells"]) >= 3) & ~(
        F.contains(T.strip_accents(r["text"]), F.lit("nombre")) & F.contains(T.strip_accents(r["text"]), F.lit("resultat"))))
    return F.transform(rows, lambda r: F.struct(
        F.trim(r["cells"][0]).alias("rang"),
        F.regexp_replace(r["cells"][1], r"[^\d]", "").try_cast("long").alias("nombre_gagnants"),
        T.parse_amount(F.trim(r["cells"][2])).alias("montant")))
