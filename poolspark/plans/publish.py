from pyspark.sql import functions as F

from poolspark.operators import category as K
from poolspark.operators import publish as U
from poolspark.operators.crowd import with_signs
from poolspark.plans.category import CATEGORY_SQL, named_pools
from poolspark.plans.registry import query
from poolspark.sources import views as V

SURPRISE_SQL = """
surprised AS (
  SELECT pool_id,
    CASE WHEN bool_or(n_out IS NULL) OR count(*) FILTER (n_out = 1 AND q1 IS NOT NULL) = 0 THEN NULL ELSE
      CAST(count(*) FILTER (n_out = 1 AND won > low) AS INT) END AS surprises,
    CASE WHEN bool_or(n_out IS NULL) OR count(*) FILTER (n_out = 1 AND q1 IS NOT NULL) = 0 THEN NULL ELSE
      CAST(count(*) FILTER (n_out = 1 AND won > low AND won >= 3.0::DOUBLE * low) AS INT) END AS big,
    CAST(count(q1) AS INT) AS priced
  FROM (SELECT pool_id, n_out, q1, least(q1, qx, q2) AS low, CASE winner WHEN 0 THEN q1 WHEN 1 THEN qx WHEN 2 THEN q2 END AS won
        FROM quoted) GROUP BY 1)"""
OWN_SQL = V.POOLS_SQL + """,
quoted AS (SELECT *, p1 AS q1, px AS qx, p2 AS q2 FROM outcomes),""" + SURPRISE_SQL


@query("surprises_per_pool", ctes=OWN_SQL, sql="SELECT pool_id, surprises, big FROM surprised")
def surprises_per_pool(spark, sf):
    small, big = U.surprises("matches", "signs")
    return with_signs(V.pools(spark, sf)).select("pool_id", small.alias("surprises"), big.alias("big"))


INDEX_SQL = CATEGORY_SQL + """,
published AS (
  SELECT match_id, p1 AS q1, px AS qx, p2 AS q2, source FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY pool_id, line) AS rn FROM outcomes WHERE plausible) WHERE rn = 1),
quoted AS (SELECT o.*, q1, qx, q2 FROM outcomes o LEFT JOIN published USING (match_id)),""" + SURPRISE_SQL + """,
played AS (SELECT pool_id, CAST(sum(slips) AS BIGINT) AS slips FROM crowd GROUP BY 1),
texts AS (SELECT pool_id, string_agg(home || '-' || away, ' · ' ORDER BY ord) AS t, min(kickoff) AS first FROM legs GROUP BY 1),
paid AS (SELECT pool_id, string_agg(rank || ':' || winners, ' ' ORDER BY rank DESC) AS r FROM payouts GROUP BY 1),
indexed AS (
  SELECT p.pool_type AS type, p.pool_id AS id, p.closed_on AS date, g.family AS famille, p.n AS matchs, s.priced AS cotees,
    net_stakes AS mises, guaranteed AS garanti, distributed AS distribue, y.slips AS jouees,
    CASE WHEN distributed <> 0 AND y.slips <> 0 THEN CAST(format('{:.4f}', distributed / y.slips) AS DOUBLE) END AS trj, paid.r AS rapports,
    t.t AS affiches, t.first AS debut, status AS statut, s.surprises, s.big AS grosses
  FROM pools p JOIN genres g USING (pool_id) JOIN surprised s USING (pool_id) JOIN texts t USING (pool_id)
  JOIN paid USING (pool_id) LEFT JOIN played y USING (pool_id))"""


def index(spark, sf):
    categories = K.categorise(named_pools(spark, sf))
    return U.published_index(V.pools(spark, sf), V.match_prices(spark, sf), categories)


@query("published_index", ctes=INDEX_SQL, sql="SELECT * FROM indexed")
def published_index(spark, sf):
    paid = F.expr("array_join(transform(rapports, r -> concat(r.rank, ':', r.winners)), ' ')")
    return index(spark, sf).withColumn("rapports", paid).select(*U.INDEX_FIELDS)


@query("upcoming_pools", ctes=INDEX_SQL, sql="""
SELECT id, type, debut FROM indexed WHERE debut > DATE '1995-02-01'""")
def upcoming_pools(spark, sf):
    return U.upcoming(index(spark, sf), F.lit("1995-02-01").cast("date")).select("id", "type", "debut")


@query("compact_prices", ctes=V.POOLS_SQL, sql="""
SELECT match_id, p1, px, p2, CASE source WHEN 'winamax' THEN 'w' WHEN 'pinnacle_cloture' THEN 'p' WHEN 'pinnacle' THEN 'p'
  WHEN 'bet365' THEN 'b' END AS letter FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY pool_id, line) AS rn FROM outcomes WHERE plausible)
WHERE rn = 1 AND source <> 'autre'""")
def compact_prices(spark, sf):
    return U.compact_prices(V.match_prices(spark, sf))
