from pyspark.sql import functions as F

from poolspark.functions import categories as C
from poolspark.operators import category as K
from poolspark.operators.matching import category_lookup
from poolspark.plans.market import FAMILY_SQL, rounded
from poolspark.plans.registry import query
from poolspark.sources import views as V

READABLE_SQL = """CASE competition WHEN 'E0' THEN 'Premier League' WHEN 'SP1' THEN 'LaLiga' WHEN 'D1' THEN 'Bundesliga'
  WHEN 'I1' THEN 'Serie A' WHEN 'F1' THEN 'Ligue 1' WHEN 'E1' THEN 'Championship' WHEN 'N1' THEN 'Eredivisie'
  ELSE competition END"""

# Competitions repeat within a pool: the derived views spread them evenly, so they are folded onto
# the pool number for part of the pools to meet every genre.
COMPETITION = "if(pool_id % 5 = 0, if(m.competition is null, null, 'F1'), if(pool_id % 5 = 1, if(m.part % 5 < 3, null, 'E0'), if(pool_id % 5 = 2, if(m.part % 2 = 0, 'E0', 'I1'), m.competition)))"
CATEGORY_SQL = V.POOLS_SQL + f""",
named AS (SELECT pool_id, pool_type, ord, CASE WHEN pool_id % 5 = 0 THEN CASE WHEN competition IS NOT NULL THEN 'F1' END
  WHEN pool_id % 5 = 1 THEN CASE WHEN part % 5 >= 3 THEN 'E0' END
  WHEN pool_id % 5 = 2 THEN CASE WHEN part % 2 = 0 THEN 'E0' ELSE 'I1' END ELSE competition END AS competition FROM outcomes),
fam AS (SELECT *, {FAMILY_SQL} AS family, {READABLE_SQL} AS readable FROM named),
genres AS (
  SELECT pool_type, pool_id, count(*) AS n, count(family) AS named,
    CASE WHEN count(family) = 0 OR count(family) < 0.6 * count(*) THEN 'indéterminée'
      WHEN bool_or(family IN ('coupe d''Europe', 'Coupe du monde', 'Copa Libertadores')) THEN 'coupes'
      WHEN bool_and(family = 'top 5') THEN 'top 5' ELSE 'autres championnats' END AS family,
    CASE WHEN count(DISTINCT competition) = 1 THEN max(readable) END AS single FROM fam GROUP BY 1, 2)"""


def named_pools(spark, sf):
    return named_of(V.pools(spark, sf))


def named_of(pools):
    return pools.select("pool_type", "pool_id", F.expr(
        f"transform(matches, m -> named_struct('competition', {COMPETITION}))").alias("matches"))


@query("category_per_pool", ctes=CATEGORY_SQL + """,
fc AS (SELECT pool_id, string_agg(family || ':' || c, ', ' ORDER BY family || ':' || c) AS families FROM
  (SELECT pool_id, family, count(*) AS c FROM fam WHERE family IS NOT NULL GROUP BY 1, 2) GROUP BY 1)""", sql="""
SELECT g.pool_type, g.pool_id, CASE WHEN single IS NOT NULL AND family <> 'indéterminée' THEN single ELSE family END AS category,
  family, coalesce(families, '') AS families, n, named FROM genres g LEFT JOIN fc USING (pool_id)""")
def category_per_pool(spark, sf):
    text = F.expr("array_join(array_sort(transform(map_entries(families), e -> concat(e.key, ':', e.value))), ', ')")
    return K.categorise(named_pools(spark, sf)).select("pool_type", "pool_id", "category", "family", text.alias("families"),
                                                       "n", "named")


@query("genre_tally", ctes=CATEGORY_SQL, sql="""
SELECT family, count(*) AS pools, round(count(*) * 100.0 / (SELECT count(*) FROM genres), 6) AS share FROM genres GROUP BY 1""")
def genre_tally(spark, sf):
    return rounded(K.genre_tally(K.categorise(named_pools(spark, sf))))


@query("single_competition_tally", ctes=CATEGORY_SQL, sql="""
SELECT single, count(*) AS pools FROM genres WHERE single IS NOT NULL GROUP BY 1""")
def single_tally(spark, sf):
    return K.single_competition_tally(K.categorise(named_pools(spark, sf)))


@query("family_tally", ctes=CATEGORY_SQL, sql="""
SELECT readable AS competition, count(*) AS matches FROM fam WHERE family IS NOT NULL GROUP BY 1
ORDER BY matches DESC, competition LIMIT 12""")
def family_tally(spark, sf):
    return K.competition_tally(K.categorise(named_pools(spark, sf)), top=12)


@query("category_lookup", ctes=CATEGORY_SQL, sql="""
SELECT coalesce(g.family, 'indéterminée') AS family, count(*) AS pools FROM pools p
LEFT JOIN (SELECT * FROM genres WHERE pool_id % 4 <> 0) g USING (pool_id) GROUP BY 1""")
def lookup(spark, sf):
    known = K.categorise(named_pools(spark, sf)).where("pool_id % 4 != 0")
    rows = category_lookup(V.pools(spark, sf).select("pool_id"), known, ["pool_id"], C.UNDETERMINED)
    return rows.groupBy("family").agg(F.count("*").alias("pools"))
