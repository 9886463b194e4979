from pyspark.sql import functions as F

from poolspark.functions import text as T
from poolspark.operators import pages as H
from poolspark.plans.registry import query
from poolspark.sources import views as V

# Archived pages written from the pools: the marked span is the outcome, amounts carry entities.
ARCHIVE_HTML = """concat('<html><table><tr><td class="head">Grille du ', cast(closed_on as string), '</td></tr>',
  array_join(transform(matches, m -> concat('<tr><td>', m.line, '</td><td class="home">', m.home, '</td><td class="result">',
    '<span class="', if(m.code = '100', 'res', ''), '">1</span><span class="', if(m.code = '010', 'res', ''),
    '">N</span><span class="', if(m.code = '001', 'res', ''), '">2</span></td><td class="ext">', m.away, '</td></tr>')), ''),
  '</table><table><tr>', array_join(transform(payouts, r -> concat('<td>', r.rank, '</td><td>', r.winners, '</td><td>',
    replace(cast(cast(coalesce(r.amount, 0) as decimal(18,2)) as string), '.', ','), '&nbsp;&euro;</td>')), ''), '</tr></table></html>')"""


def archive_pages(spark, sf):
    return V.pools(spark, sf).select("pool_id", "closed_on", F.expr(ARCHIVE_HTML).alias("html"))


@query("page_rows_extract", ctes=V.POOLS_SQL + """,
paid AS (SELECT pool_id, string_agg(rank || ':' || winners || ':' || CAST(coalesce(amount, 0) AS DECIMAL(18,2)), ' ' ORDER BY rank DESC) AS r
  FROM payouts GROUP BY 1)""", sql="""
SELECT p.pool_id, 'Grille du ' || CAST(p.closed_on AS VARCHAR) AS date, CAST(count(*) AS INT) AS matches,
  string_agg(home || '-' || away || '=' || CASE code WHEN '100' THEN '1' WHEN '010' THEN 'N' WHEN '001' THEN '2' ELSE '?' END, ' | '
    ORDER BY ord) AS lines, any_value(r) AS rapports, bool_and(code IN ('100','010','001')) AS reglee
FROM legs l JOIN pools p USING (pool_id) JOIN paid USING (pool_id) GROUP BY 1, 2""")
def page_rows(spark, sf):
    rows = H.archive_page(archive_pages(spark, sf))
    return rows.select(
        "pool_id", "date", F.size("matchs").alias("matches"),
        F.expr("array_join(transform(matchs, m -> concat(m.home, '-', m.away, '=', coalesce(m.issue, '?'))), ' | ')").alias("lines"),
        F.expr("array_join(transform(rapports, r -> concat(r.bons, ':', r.gagnants, ':', cast(r.rapport as decimal(18,2)))), ' ')")
        .alias("rapports"), "reglee")


# Price pages: some have no price table and some miss rows; the list always holds every fixture.
PRICE_HTML = """concat('<ul class="repart">', array_join(transform(matches, m -> concat('<li><span>', m.line,
    '.</span><span class="team">Equipe', m.part % 211, ' - ', m.away, '</span><div class="perc">48,5%</div></li>')), ''), '</ul>',
  if(pool_id % 6 = 0, '', concat('<table><tr><th>1</th></tr>', array_join(transform(filter(matches, (m, i) -> pool_id % 6 != 1 or i % 2 = 0),
    m -> concat('<tr id="m"><td><span data-date-utc="', m.kickoff, ' 13:55:00">x</span></td><td class="match">Equipe', m.part % 211,
      '-', m.away, '</td><td class="cote-d">38%<span class="dev_span_1">', coalesce(replace(cast(m.p1 as string), '.', ','), ''),
      '</span></td><td>29%<span class="dev_span_n">', coalesce(replace(cast(m.px as string), '.', ','), ''),
      '</span></td><td>33%<span class="dev_span_2">', coalesce(replace(cast(m.p2 as string), '.', ','), ''), '</span></td><td class="dev_s">',
      coalesce(concat(m.score_home, '-', m.score_away), ''), '</td></tr>')), ''), '</table>')))"""


@query("price_page_extract")
def price_pages(spark, sf):
    """All pools, also those in which a team number repeats, so that a line has twins; held against brute force in the tests."""
    return price_lines(V.pools(spark, sf))


def price_lines(pools):
    rows = H.price_page(pools.select("pool_id", F.expr(PRICE_HTML).alias("html")))
    return rows.select("pool_id", F.expr(
        """array_join(transform(lines, l -> concat(l.home, '-', l.away, '@', coalesce(l.debut, ''), '=', if(l.cotes is null, '', 'x'),
        coalesce(concat(l.score[0], ':', l.score[1]), ''))), ' | ')""").alias("lines"),
        F.round(F.expr("""aggregate(lines, 0D, (a, l) -> a + coalesce(l.cotes[0] + l.cotes[1] * 2 + l.cotes[2] * 3, 0D))"""), 6)
        .alias("price_sum"))


DATATABLE_HTML = """concat('<div data-wpdatatable_id="', pool_id, '"><th class="wdtheader x">id</th>',
  case pool_id % 3 when 0 then '<th class="wdtheader">H</th><th class="wdtheader">D</th><th class="wdtheader"> A</th>'
    when 1 then '<th class="wdtheader">FTHG</th><th class="wdtheader">FTAG</th>' else '<th class="wdtheader">H</th>' end, '</div>',
  if(pool_id % 5 = 0, '', concat('<input name="wdtNonceFrontendServerSide_', pool_id, '" value="t', pool_id * 7, '">')))"""


@query("table_discovery", ctes=V.POOLS_SQL, sql="""
SELECT pool_id, CAST(pool_id AS VARCHAR) AS table_id, CASE pool_id % 3 WHEN 0 THEN 'cotes' ELSE 'scores' END AS kind,
  't' || pool_id * 7 AS token FROM pools WHERE pool_id % 3 <> 2 AND pool_id % 5 <> 0""")
def table_discovery(spark, sf):
    pages = V.pools(spark, sf).select("pool_id", F.expr(DATATABLE_HTML).alias("html"))
    return H.data_tables(pages, "html", "pool_id").select("pool_id", "table_id", "kind", "token")


@query("table_heads_cut", ctes=V.POOLS_SQL, sql="""
SELECT pool_id, CAST(pool_id AS VARCHAR) AS table_id, 1 AS read, CASE pool_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS beyond
FROM pools WHERE pool_id % 7 * 1000 >= 4000""")
def table_heads_cut(spark, sf):
    """The pages of ``table_discovery`` with up to 6,000 characters between the first header and the others."""
    long = F.regexp_replace(F.expr(DATATABLE_HTML), "(id</th>)", F.concat(F.lit("$1"), F.expr("repeat('-', cast(pool_id % 7 * 1000 as int))")))
    pages = V.pools(spark, sf).select("pool_id", long.alias("html"))
    return H.cut_heads(pages, "html", "pool_id")


def staged_pages(spark, sf):
    """Rendered rows of the pools: cancelled, blank and missing cells, nameless rows, unsettled pages."""
    row = """named_struct('text', concat(m.home, '1N2', m.away, if(m.mix % 67 = 0, '', coalesce(concat(m.score_home, ' - ', m.score_away), 'Annulé'))),
      'teams', if(m.mix % 61 = 0, array(m.home), array(m.home, m.away)),
      'cell', case when m.mix % 61 = 0 then null when m.code = '111' then 'Annulé' when m.mix % 67 = 0 then ''
        else concat(m.score_home, ' - ', m.score_away) end)"""
    return V.pools(spark, sf).select(
        "pool_id",
        F.expr("""concat(if(pool_id % 13 = 0, 'En cours', 'Terminée'), if(pool_id % 17 = 0, ' match annulé hier', ''),
          ' Montant distribué : ', replace(cast(cast(coalesce(distributed, 0) as decimal(18,2)) as string), '.', ','), ' €')""").alias("body"),
        F.expr(f"if(pool_id % 51 = 0, slice(transform(matches, m -> {row}), 1, 0), transform(matches, m -> {row}))").alias("rows"),
        F.expr("""concat(array(named_struct('text', 'Nombre de bons résultats', 'cells', array('a', 'b', 'c'))),
          transform(payouts, r -> named_struct('text', 'x', 'cells', array(cast(r.rank as string), concat(r.winners, ' gagnants'),
            concat(replace(cast(cast(r.amount as decimal(18,2)) as string), '.', ','), ' €')))))""").alias("report_rows"))


@query("page_status", ctes=V.POOLS_SQL + """,
r AS (
  SELECT pool_id, count(*) FILTER (kind IN ('played', 'cancelled')) AS ok, count(*) FILTER (kind = 'cancelled') AS cancelled,
    count(*) FILTER (kind = 'doubtful') AS doubtful, count(*) FILTER (kind = 'discarded') AS discarded
  FROM (SELECT pool_id, CASE WHEN mix % 61 = 0 THEN 'discarded' WHEN code = '111' THEN 'cancelled' WHEN mix % 67 = 0 THEN
      'doubtful' ELSE 'played' END AS kind FROM legs WHERE pool_id % 51 <> 0) GROUP BY 1),
s AS (SELECT p.*, CASE WHEN ok > 0 THEN ok + doubtful ELSE 0 END AS ok, CASE WHEN ok > 0 THEN cancelled + doubtful ELSE 0 END AS cancelled,
    coalesce(discarded, 0) + CASE WHEN ok > 0 THEN 0 ELSE coalesce(doubtful, 0) END AS discarded,
    p.pool_id % 13 <> 0 AS settled, p.pool_id % 17 = 0 AS mention FROM pools p LEFT JOIN r USING (pool_id)),
st AS (SELECT *, CASE WHEN ok > 0 AND settled THEN 'terminee' WHEN ok = 0 AND mention THEN 'annulee' END AS statut FROM s),
paid AS (SELECT pool_id, string_agg(rank || ':' || winners || ':' || coalesce(CAST(amount AS DECIMAL(18,2))::VARCHAR, '?'), ' ' ORDER BY rank DESC) AS r
  FROM payouts GROUP BY 1)""", sql="""
SELECT pool_id, statut, CAST(CASE WHEN statut = 'terminee' THEN ok WHEN statut IS NULL THEN ok ELSE 0 END AS INT) AS matches,
  CAST(CASE WHEN statut = 'annulee' THEN 0 ELSE cancelled END AS INT) AS cancelled,
  CASE WHEN statut IS DISTINCT FROM 'annulee' AND discarded > 0 THEN CAST(discarded AS INT) END AS discarded,
  CASE WHEN statut IS DISTINCT FROM 'annulee' THEN coalesce(distributed, 0) END AS montant,
  CASE WHEN statut = 'annulee' THEN '' ELSE r END AS rapports, statut = 'annulee' AS has_hint,
  coalesce(statut = 'terminee' AND mention AND cancelled = 0, FALSE) AS unexplained
FROM st JOIN paid USING (pool_id)""")
def page_status(spark, sf):
    rows = H.page_record(staged_pages(spark, sf))
    return rows.select(
        "pool_id", "statut", F.size("matches").alias("matches"),
        F.expr("size(filter(matches, m -> m.resultat = 'annule'))").alias("cancelled"),
        F.when(F.col("lignes_ignorees").isNotNull(), F.size("lignes_ignorees")).alias("discarded"),
        F.col("montant_distribue").alias("montant"),
        F.expr("""array_join(transform(rapports, r -> concat(r.rang, ':', r.nombre_gagnants, ':',
          coalesce(cast(cast(r.montant as decimal(18,2)) as string), '?'))), ' ')""").alias("rapports"),
        (F.col("statut") == "annulee").alias("has_hint"), F.col("mention_annulation").isNotNull().alias("unexplained"))


@query("page_titles", sql=r"""
SELECT page_id, regexp_replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '<[^>]+>', '', 'g'),
  '&nbsp;', ' '), '&euro;', '€'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS title,
  CAST(len(regexp_extract_all(html, '<li[^>]*>')) AS INT) AS items FROM pages""")
def page_titles(spark, sf):
    return V.table(spark, sf, "pages").select(
        "page_id", T.clean_html_text(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit(r"<li[^>]*>"), F.lit(0))).alias("items"))


TITLE_SQL = r"""SELECT page_id, regexp_replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '<[^>]+>', '', 'g'),
  '&nbsp;', ' '), '&euro;', '€'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS title FROM pages"""


@query("title_composition", sql=f"SELECT page_id, nfc_normalize('Équipe Ñandú ' || title) AS title, TRUE AS same FROM ({TITLE_SQL})")
def title_composition(spark, sf):
    """Titles written with separate marks are the titles written with whole letters."""
    whole = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    rows = V.table(spark, sf, "pages").select("page_id", F.concat(F.lit("Équipe Ñandú "), T.clean_html_text(whole)).alias("title"))
    again = rows.withColumn("again", T.decompose("title")).withColumn("again", T.compose("again"))
    return again.select("page_id", T.clean_html_text("again").alias("title"), (F.col("again") == T.compose("title")).alias("same"))
