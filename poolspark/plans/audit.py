from pyspark.sql import functions as F

from poolspark.operators import audit as A
from poolspark.plans.market import rounded
from poolspark.plans.registry import query
from poolspark.sources import views as V


#: Numbers taken out where missing numbers are what a query looks for.
HOLES = "pool_id % 40 = 7 OR pool_id BETWEEN 1000 AND 1100"


def page_pools(spark, sf):
    """All pools in page form, with faults injected by key."""
    pools = V.pools(spark, sf)
    match = """named_struct('home', if(m.mix % 113 = 0, ' ', m.home), 'away', m.away,
      'score_home', if(m.mix % 127 = 0, null, cast(m.score_home as bigint)), 'score_away', cast(m.score_away as bigint),
      'resultat', case when m.code = '111' then 'annule' when m.mix % 131 = 0 then '2'
        when m.score_home > m.score_away then '1' when m.score_home < m.score_away then '2' else 'N' end,
      'tous_gagnants', if(m.code = '111', if(m.mix % 3 = 0, null, true), null), 'annulation_deduite_de', cast(null as string))"""
    reports = """transform(payouts, r -> named_struct('rang', cast(r.rank as string), 'nombre_gagnants', r.winners, 'montant', r.amount))"""
    paid = "aggregate(payouts, 0D, (a, r) -> a + r.winners * coalesce(r.amount, 0D))"
    return pools.select(
        F.when(F.col("pool_id") % 101 != 0, F.col("pool_id")).alias("grille_id"),
        F.concat(F.lit("grille"), F.col("pool_type").cast("string")).alias("grille_type"),
        F.when(F.col("pool_id") % 43 == 0, "annulee").otherwise("terminee").alias("statut"),
        F.expr(f"case when pool_id % 43 = 0 and pool_id % 2 = 0 then slice(transform(matches, m -> {match}), 1, 0) "
               f"else transform(matches, m -> {match}) end").alias("matches"),
        F.expr(f"case when pool_id % 43 = 0 or pool_id % 47 = 0 then slice({reports}, 1, 0) else {reports} end").alias("rapports"),
        F.expr(f"{paid} + case pool_id % 17 when 0 then 5D when 1 then 0.1D else 0D end").alias("montant_distribue"),
        F.expr("if(pool_id % 53 = 0, 'annul', null)").alias("mention_annulation"),
        F.expr("if(pool_id % 59 = 0, array(named_struct('ligne', 1, 'motif', 'x', 'texte', 'y')), null)").alias("lignes_ignorees"))


def holed_pools(spark, sf):
    return page_pools(spark, sf).where(f"grille_id IS NULL OR NOT ({HOLES.replace('pool_id', 'grille_id')})")


PAGE_SQL = V.POOLS_SQL + """,
page AS (SELECT *, CASE WHEN pool_id % 101 <> 0 THEN pool_id END AS gid, 'grille' || pool_type AS gtype FROM pools),
page_matches AS (
  SELECT l.pool_id, l.ord, g.gid, g.gtype, CASE WHEN mix % 113 = 0 THEN ' ' ELSE home END AS home, away,
    CASE WHEN mix % 127 = 0 THEN NULL ELSE score_home END AS sh, score_away AS sa,
    CASE WHEN code = '111' THEN 'annule' WHEN mix % 131 = 0 THEN '2' WHEN score_home > score_away THEN '1'
      WHEN score_home < score_away THEN '2' ELSE 'N' END AS res,
    CASE WHEN code = '111' AND mix % 3 <> 0 THEN TRUE END AS won
  FROM legs l JOIN page g USING (pool_id) WHERE NOT (l.pool_id % 43 = 0 AND l.pool_id % 2 = 0)),
page_payouts AS (SELECT r.*, g.gid, g.gtype FROM payouts r JOIN page g USING (pool_id) WHERE r.pool_id % 43 <> 0 AND r.pool_id % 47 <> 0),
amounts AS (SELECT pool_id, sum(winners * coalesce(amount, 0)) + CASE pool_id % 17 WHEN 0 THEN 5 WHEN 1 THEN 0.1 ELSE 0 END AS md
  FROM payouts GROUP BY 1),
found AS (
  SELECT gtype, gid, 'champ « grille_id » absent' AS what, NULL::INT AS ord FROM page WHERE gid IS NULL
  UNION ALL SELECT gtype, gid, 'annulée mais listes non vides', NULL FROM page WHERE gid IS NOT NULL AND pool_id % 43 = 0 AND pool_id % 2 <> 0
  UNION ALL SELECT gtype, gid, w, ord FROM (
    SELECT *, unnest([
      CASE WHEN trim(home) = '' THEN 'match sans nom d''équipe' END,
      CASE WHEN trim(home) <> '' AND res = 'annule' AND (sh IS NOT NULL OR sa IS NOT NULL) THEN 'match annulé mais avec un score' END,
      CASE WHEN trim(home) <> '' AND res = 'annule' AND NOT coalesce(won, FALSE) THEN 'match annulé sans tous_gagnants' END,
      CASE WHEN trim(home) <> '' AND res <> 'annule' AND (sh IS NULL OR sa IS NULL) THEN 'match sans score et non annulé' END,
      CASE WHEN trim(home) <> '' AND res <> 'annule' AND sh IS NOT NULL AND sa IS NOT NULL AND
        res <> CASE WHEN sh > sa THEN '1' WHEN sa > sh THEN '2' ELSE 'N' END THEN 'résultat contraire au score' END]) AS w
    FROM page_matches WHERE gid IS NOT NULL AND pool_id % 43 <> 0) WHERE w IS NOT NULL
  UNION ALL SELECT gtype, gid, 'terminée mais sans rapports ni montant', NULL FROM page
    WHERE gid IS NOT NULL AND pool_id % 43 <> 0 AND pool_id % 47 = 0
  UNION ALL SELECT gtype, gid, 'rapport incomplet', NULL FROM page_payouts WHERE gid IS NOT NULL AND amount IS NULL
  UNION ALL SELECT gtype, gid, 'somme des rapports ≠ montant distribué', NULL FROM (
    SELECT gtype, gid, md, coalesce(sum(winners * amount), 0) AS total, coalesce(sum(winners) FILTER (amount IS NOT NULL), 0) AS w
    FROM page_payouts JOIN amounts USING (pool_id) WHERE gid IS NOT NULL GROUP BY 1, 2, 3)
    WHERE abs(total - md) > 0.005 * w + 0.02)"""


@query("pool_audit", ctes=PAGE_SQL, sql="SELECT gtype AS grille_type, gid AS grille_id, what, ord FROM found")
def pool_audit(spark, sf):
    return A.anomalies(page_pools(spark, sf)).drop("detail")


@query("audit_summary", ctes=PAGE_SQL, sql="""
SELECT gtype AS grille_type, count(*) AS pools, min(gid) AS first_id, max(gid) AS last_id,
  count(*) FILTER (pool_id % 43 <> 0) AS settled, count(*) FILTER (pool_id % 43 = 0) AS cancelled_pools,
  CAST(coalesce(sum(m.n), 0) AS BIGINT) AS matches, CAST(coalesce(sum(m.c), 0) AS BIGINT) AS cancelled,
  count(*) FILTER (pool_id % 59 = 0) AS discarded, count(*) FILTER (pool_id % 53 = 0) AS mentions
FROM page LEFT JOIN (SELECT pool_id, count(*) AS n, count(*) FILTER (res = 'annule') AS c FROM page_matches GROUP BY 1) m
  USING (pool_id) GROUP BY 1""")
def audit_summary(spark, sf):
    return A.summary(page_pools(spark, sf))


@query("duplicate_contents", sql="""
WITH c AS (SELECT l_orderkey AS id, list(l_linenumber ORDER BY l_linenumber) AS m
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1),
f AS (SELECT m, min(id) AS first_id FROM c GROUP BY 1)
SELECT 'grille7' AS grille_type, id AS grille_id, first_id FROM c JOIN f USING (m) WHERE id <> first_id""")
def duplicate_contents(spark, sf):
    rows = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("grille_id")).agg(
        F.array_sort(F.collect_set("l_linenumber")).alias("matches"))
    return A.duplicate_contents(rows.withColumn("grille_type", F.lit("grille7")))


GAPS_SQL = PAGE_SQL + f""",
holed AS (SELECT * FROM page WHERE gid IS NULL OR NOT ({HOLES})),
runs AS (SELECT gtype, gid + 1 AS first_missing, nxt - 1 AS last_missing, nxt - gid - 1 AS length, nxt - gid - 1 <= 20 AS hole
  FROM (SELECT gtype, gid, lead(gid) OVER (PARTITION BY gtype ORDER BY gid) AS nxt FROM holed WHERE gid IS NOT NULL)
  WHERE nxt - gid > 1)"""


def runs(spark, sf):
    return A.gaps(holed_pools(spark, sf).where("grille_id IS NOT NULL"), ["grille_type"], "grille_id")


@query("id_gaps", ctes=GAPS_SQL, sql="SELECT gtype AS grille_type, first_missing, last_missing, length, hole FROM runs")
def id_gaps(spark, sf):
    return runs(spark, sf)


@query("gap_summary", ctes=GAPS_SQL, sql="""
SELECT gtype AS grille_type, hole, count(*) AS runs, CAST(sum(length) AS BIGINT) AS missing FROM runs GROUP BY 1, 2""")
def gap_summary(spark, sf):
    return A.gap_summary(runs(spark, sf), ["grille_type"])


@query("missing_ids", ctes=GAPS_SQL, sql="""
SELECT gtype AS grille_type, unnest(range(first_missing, last_missing + 1)) AS missing_id FROM runs WHERE hole""")
def missing_ids(spark, sf):
    return A.missing_ids(runs(spark, sf), ["grille_type"])


@query("recollection_worklist", ctes=GAPS_SQL, sql="""
SELECT gtype AS grille_type, gid AS grille_id, 'lignes écartées' AS reason FROM holed WHERE pool_id % 59 = 0
UNION ALL SELECT gtype, gid, 'mention d''annulation' FROM holed WHERE pool_id % 53 = 0
UNION ALL SELECT gtype, unnest(range(first_missing, last_missing + 1)), 'trous' FROM runs WHERE hole""")
def recollection(spark, sf):
    return A.worklist(holed_pools(spark, sf), A.missing_ids(runs(spark, sf), ["grille_type"]))


@query("availability_windows", ctes=V.POOLS_SQL, sql="""
SELECT pool_type, CAST(year(closed_on) AS INT) AS year, count(*) AS pools,
  round(count(*) FILTER (has_histogram) / count(*), 6) AS filled_share, min(pool_id) FILTER (has_histogram) AS first_filled,
  max(pool_id) FILTER (has_histogram) AS last_filled FROM pools GROUP BY 1, 2""")
def availability(spark, sf):
    return rounded(A.availability(V.pools(spark, sf), F.col("histogram").isNotNull(), ["pool_type"], "pool_id", F.year("closed_on")))


@query("audit_screen", ctes=PAGE_SQL, sql="""
SELECT gtype AS grille_type, gid AS grille_id, what, ord FROM found
ORDER BY grille_type, grille_id, what, ord LIMIT 40""")
def audit_screen(spark, sf):
    rows = A.anomalies(page_pools(spark, sf)).drop("detail")
    return A.screen(rows, A.SCREEN_ANOMALIES, "grille_type", F.asc_nulls_last("grille_id"), "what", F.asc_nulls_last("ord"))
