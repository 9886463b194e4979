from pyspark.sql import functions as F

from poolspark.functions import categories as C
from poolspark.functions import prices as P
from poolspark.operators import market as M
from poolspark.plans.registry import query
from poolspark.sources import views as V

ORDER = ["pool_type", "pool_id", "ord"]

QUALIFIED_SQL = V.POOLS_SQL + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY pool_type, pool_id, ord) AS rn
  FROM outcomes WHERE winner IS NOT NULL AND plausible),
qualified AS (SELECT * FROM ranked WHERE rn = 1),
bets AS (
  SELECT q.*, o.k AS outcome, CASE o.k WHEN 0 THEN p1 WHEN 1 THEN px ELSE p2 END AS price, o.k = winner AS won
  FROM qualified q, range(0, 3) o(k))"""


def qualified(spark, sf):
    rows = M.explode_matches(V.pools(spark, sf), "pool_type", "pool_id")
    return M.qualified_matches(rows, ORDER, where=P.plausible_market("p1", "px", "p2"))


def rounded(df, *exact):
    """Round every computed double to six decimals: sums differ by their order between engines."""
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double"
                       and f.name not in exact else F.col(f.name) for f in df.schema.fields])


@query("banded_return", ctes=QUALIFIED_SQL, sql="""
SELECT low AS band_low, high AS band_high, count(*) AS n, round(avg(CASE WHEN won THEN price ELSE 0 END), 6) AS mean_return,
  round(1.96 * sqrt(var_pop(CASE WHEN won THEN price ELSE 0 END) / count(*)), 6) AS margin,
  round(avg(CASE WHEN won THEN 1.0 ELSE 0.0 END), 6) AS win_rate
FROM bets JOIN (VALUES (1.0::DOUBLE, 1.3::DOUBLE), (1.3, 1.6), (1.6, 2.0), (2.0, 2.5), (2.5, 3.2), (3.2, 4.5), (4.5, 7.0),
  (7.0, 12.0), (12.0, 'inf')) b(low, high) ON price >= low AND price < high
GROUP BY low, high HAVING count(*) >= 100""")
def banded_return(spark, sf):
    return rounded(M.banded_return(qualified(spark, sf)), "band_low", "band_high")


_SIDES = """, count(*) FILTER (price < 2.5) AS n_favourite,
  round(coalesce(avg(CASE WHEN won THEN price ELSE 0 END) FILTER (price < 2.5), 0), 6) AS favourite_return,
  round(coalesce(1.96 * sqrt(var_pop(CASE WHEN won THEN price ELSE 0 END) FILTER (price < 2.5)
    / count(*) FILTER (price < 2.5)), 0), 6) AS favourite_margin,
  count(*) FILTER (price >= 4.5) AS n_longshot,
  round(coalesce(avg(CASE WHEN won THEN price ELSE 0 END) FILTER (price >= 4.5), 0), 6) AS longshot_return,
  round(coalesce(1.96 * sqrt(var_pop(CASE WHEN won THEN price ELSE 0 END) FILTER (price >= 4.5)
    / count(*) FILTER (price >= 4.5)), 0), 6) AS longshot_margin,
  round(count(*) FILTER (outcome = 0 AND won) / (count(*) / 3.0), 6) AS home_rate,
  count(*) // 3 AS n_matches"""


@query("favourite_longshot_by_source", ctes=QUALIFIED_SQL, sql=f"""
SELECT source {_SIDES} FROM bets GROUP BY source HAVING count(*) // 3 >= 500""")
def by_source(spark, sf):
    return rounded(M.favourite_longshot(qualified(spark, sf), "source", M.MIN_SOURCE_MATCHES))


FAMILY_SQL = """CASE WHEN competition IS NULL THEN NULL
  WHEN competition IN ('E0','SP1','D1','I1','F1') THEN 'top 5'
  WHEN competition IN ('Champions League','Europa League','Conference League') THEN 'coupe d''Europe'
  WHEN competition IN ('E1','SP2','D2','I2','F2','E2','E3','EC','SC1','SC2','SC3') THEN 'deuxième division'
  WHEN competition IN ('N1','B1','P1','T1','G1','SC0') THEN 'autre championnat européen'
  WHEN competition = 'Copa Libertadores' THEN 'Copa Libertadores'
  WHEN competition LIKE 'World Cup%' THEN 'Coupe du monde' ELSE 'autre championnat' END"""


@query("favourite_longshot_by_family", ctes=QUALIFIED_SQL, sql=f"""
SELECT coalesce({FAMILY_SQL}, 'indéterminée') AS family {_SIDES} FROM bets GROUP BY 1 HAVING count(*) // 3 >= 400""")
def by_family(spark, sf):
    rows = qualified(spark, sf).withColumn("family", F.coalesce(C.family("competition"), F.lit(C.UNDETERMINED)))
    return rounded(M.favourite_longshot(rows, "family", M.MIN_FAMILY_MATCHES))


@query("qualified_first_occurrence", ctes=QUALIFIED_SQL, sql="""
SELECT match_id, pool_type, pool_id, ord, CAST(winner AS INT) AS winner, p1, px, p2, source,
  CAST(year(kickoff) AS INT) AS year FROM qualified""")
def first_occurrence(spark, sf):
    return qualified(spark, sf).select("match_id", "pool_type", "pool_id", "ord", "winner", "p1", "px", "p2",
                                       "source", F.year("kickoff").alias("year"))


@query("flat_stake_summary", ctes=QUALIFIED_SQL, sql="""
SELECT count(*) AS n, round(coalesce(avg(CASE WHEN won THEN price ELSE 0 END), 0), 6) AS mean_return,
  round(coalesce(1.96 * sqrt(var_pop(CASE WHEN won THEN price ELSE 0 END) / count(*)), 0), 6) AS margin FROM bets""")
def flat_stake(spark, sf):
    return rounded(M.bets(qualified(spark, sf)).agg(*M.flat_return()))


@query("implied_probabilities", ctes=V.POOLS_SQL, sql="""
SELECT pool_id, ord, round((1/p1) / (1/p1 + 1/px + 1/p2), 6) AS prob_1, round((1/px) / (1/p1 + 1/px + 1/p2), 6) AS prob_x,
  round((1/p2) / (1/p1 + 1/px + 1/p2), 6) AS prob_2, round(1/p1 + 1/px + 1/p2, 6) AS margin_sum,
  1/p1 + 1/px + 1/p2 BETWEEN 1.0 AND 1.4 AND least(p1, px, p2) >= 1.01 AND greatest(p1, px, p2) <= 100 AS signature,
  CAST(CASE WHEN p1 <= px AND p1 <= p2 THEN 0 WHEN px <= p2 THEN 1 ELSE 2 END AS INT) AS favourite
FROM outcomes WHERE plausible""")
def implied(spark, sf):
    rows = M.explode_matches(V.pools(spark, sf), "pool_id").where(P.plausible_market("p1", "px", "p2"))
    probs = P.implied_probs("p1", "px", "p2")
    return rounded(rows.select(
        "pool_id", "ord", probs[0].alias("prob_1"), probs[1].alias("prob_x"), probs[2].alias("prob_2"),
        P.overround("p1", "px", "p2").alias("margin_sum"), P.has_market_signature("p1", "px", "p2").alias("signature"),
        P.favourite(F.array("p1", "px", "p2")).alias("favourite")))


@query("calibration_buckets", ctes=QUALIFIED_SQL, sql="""
SELECT source, CAST(least(floor(p * 20), 19) AS INT) AS bucket, count(*) AS n, round(avg(p), 6) AS mean_p,
  round(avg(CASE WHEN won THEN 1.0 ELSE 0.0 END), 6) AS observed, round(avg(o), 6) AS mean_overround
FROM (SELECT *, 1/p1 + 1/px + 1/p2 AS o, (1/price) / (1/p1 + 1/px + 1/p2) AS p FROM bets) GROUP BY 1, 2""")
def calibration(spark, sf):
    return rounded(M.calibration(qualified(spark, sf), "source"))


@query("combo_retention_quantiles", ctes=V.POOLS_SQL, sql="""
SELECT count(*) AS n, round(max(r) FILTER (i = n // 4), 6) AS q1, round(max(r) FILTER (i = n // 2), 6) AS median,
  round(max(r) FILTER (i = 3 * n // 4), 6) AS q3, round(0.75 / max(r) FILTER (i = n // 2), 6) AS pool_over_combo
FROM (SELECT r, row_number() OVER (ORDER BY r) - 1 AS i, count(*) OVER () AS n FROM (
  SELECT exp(sum(ln(1 / (1/p1 + 1/px + 1/p2)))) AS r FROM outcomes GROUP BY pool_id HAVING bool_and(plausible)))
HAVING count(*) >= 30""")
def combo(spark, sf):
    return rounded(M.combo_quantiles(M.combo_retentions(V.pools(spark, sf))))
