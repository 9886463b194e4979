from pyspark.sql import functions as F

from poolspark.operators import crowd as C
from poolspark.operators import resample as R
from poolspark.plans.market import rounded
from poolspark.plans.registry import query
from poolspark.session import cut_lineage
from poolspark.sources import views as V

EVAL_SQL = V.POOLS_SQL + """,
judged AS (
  SELECT pool_id, pool_type, count(*) AS n,
    sum(CASE WHEN (CASE WHEN p1 <= px AND p1 <= p2 THEN 0 WHEN px <= p2 THEN 1 ELSE 2 END) = winner THEN 1 ELSE 0 END)
      AS hits,
    sum((1 / (CASE winner WHEN 0 THEN p1 WHEN 1 THEN px ELSE p2 END)) / (1/p1 + 1/px + 1/p2)) AS psum
  FROM outcomes GROUP BY 1, 2 HAVING bool_and(plausible) AND bool_and(winner IS NOT NULL)),
played AS (SELECT pool_id, CAST(sum(slips) AS BIGINT) AS slips, sum(k * slips) AS hitsum FROM crowd GROUP BY 1),
evaluated AS (
  SELECT j.pool_id, j.pool_type, year(p.closed_on) AS year, CAST(j.n AS INT) AS n, y.slips,
    y.hitsum / y.slips / j.n AS crowd, j.hits / j.n AS favourite, j.psum / j.n AS proportional,
    CAST(j.hits AS INT) AS favourite_hits,
    coalesce((SELECT max(coalesce(amount, 0)) FROM payouts r WHERE r.pool_id = j.pool_id AND r.rank = j.hits), 0)
      AS favourite_gain
  FROM judged j JOIN played y USING (pool_id) JOIN pools p USING (pool_id))"""


def evaluated(spark, sf):
    return C.evaluate(V.pools(spark, sf))


@query("pool_evaluation", ctes=EVAL_SQL, sql="""
SELECT pool_id, pool_type, CAST(year AS INT) AS year, n, slips, round(crowd, 6) AS crowd, round(favourite, 6) AS favourite,
  round(proportional, 6) AS proportional, favourite_hits, round(favourite_gain, 6) AS favourite_gain FROM evaluated""")
def pool_evaluation(spark, sf):
    return rounded(evaluated(spark, sf))


@query("crowd_overall", ctes=EVAL_SQL, sql="""
SELECT count(*) AS pools, round(avg(crowd), 6) AS crowd, round(avg(favourite), 6) AS favourite,
  round(avg(proportional), 6) AS proportional, round(avg(n), 6) AS mean_size, CAST(sum(slips) AS BIGINT) AS slips,
  round((avg(favourite) - avg(crowd)) * 100, 6) AS points_to_favourite,
  round((avg(proportional) - avg(crowd)) * 100, 6) AS points_to_proportional FROM evaluated""")
def crowd_overall(spark, sf):
    return rounded(C.overall(evaluated(spark, sf)))


@query("crowd_by_year", ctes=EVAL_SQL, sql="""
SELECT CAST(year AS INT) AS year, count(*) AS pools, round(avg(crowd), 6) AS crowd, round(avg(favourite), 6) AS favourite,
  round((avg(crowd) - avg(favourite)) * 100, 6) AS gap FROM evaluated GROUP BY 1 HAVING count(*) >= 20""")
def crowd_by_year(spark, sf):
    return rounded(C.by_year(evaluated(spark, sf)))


@query("crowd_rollup_by_type", ctes=EVAL_SQL, sql="""
SELECT pool_type, count(*) AS pools, round(avg(favourite_gain), 6) AS mean_return,
  round(avg(CASE WHEN favourite_gain > 0 THEN 1.0 ELSE 0.0 END), 6) AS paid_share
FROM evaluated GROUP BY ROLLUP (pool_type) HAVING count(*) >= 30""")
def crowd_by_type(spark, sf):
    return rounded(C.by_type(evaluated(spark, sf)))


@query("favourite_slip_economics", ctes=EVAL_SQL, sql="""
SELECT count(*) AS n, round(avg(favourite_gain), 6) AS mean_return,
  round(avg(CASE WHEN favourite_gain > 0 THEN 1.0 ELSE 0.0 END), 6) AS paid_share, round(max(favourite_gain), 6) AS largest,
  round(sum(favourite_gain) FILTER (i <= greatest(1, n_all // 100)) / sum(favourite_gain), 6) AS top_share
FROM (SELECT *, row_number() OVER (ORDER BY favourite_gain DESC) AS i, count(*) OVER () AS n_all FROM evaluated)""")
def favourite_economics(spark, sf):
    rows = evaluated(spark, sf).select("pool_id", "favourite_gain")
    share = R.top_share_frame(rows, "favourite_gain")
    paid = rows.agg(F.avg((F.col("favourite_gain") > 0).cast("double"))).scalar()
    return rounded(share.select("n", (F.col("total") / F.col("n")).alias("mean_return"), paid.alias("paid_share"),
                                "largest", "top_share"))


MIX_SQL = """(((((b*40503 + ix*9973 + 1789) % 2147483629) * ((b*40503 + ix*9973 + 1789) % 2147483629) + 7) % 2147483629)
  * ((((b*40503 + ix*9973 + 1789) % 2147483629) * ((b*40503 + ix*9973 + 1789) % 2147483629) + 7) % 2147483629) + 3) % 2147483629"""


@query("bootstrap_ci", ctes=EVAL_SQL + f""",
vals AS (SELECT row_number() OVER (ORDER BY pool_id) - 1 AS ix, count(*) OVER () AS n, favourite_gain AS v FROM evaluated),
draws AS (SELECT b, {MIX_SQL} % n AS ix FROM vals, range(0, 4000) r(b)),
means AS (SELECT b, avg(v) AS m FROM draws JOIN vals USING (ix) GROUP BY 1),
ordered AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i FROM means)""", sql="""
SELECT 'favourite_gain' AS name, round(max(m) FILTER (i = 100), 6) AS low, round(max(m) FILTER (i = 3900), 6) AS high
FROM ordered""")
def bootstrap_ci(spark, sf):
    return rounded(R.bootstrap_interval(evaluated(spark, sf), ["favourite_gain"], "pool_id", R.ANALYSIS_REPLICATES))


WEIGHT_SQL = "(" + " + ".join(f"CASE WHEN u >= {limit} THEN 1 ELSE 0 END" for limit in R.poisson_limits()) + ")"


@query("bootstrap_ci_poisson", ctes=EVAL_SQL + f""",
vals AS (SELECT pool_id AS ix, favourite_gain AS v FROM evaluated),
hashed AS (SELECT b, v, {MIX_SQL} AS u FROM vals, range(0, 4000) r(b)),
weighted AS (SELECT b, v, {WEIGHT_SQL} AS w FROM hashed),
means AS (SELECT b, sum(v * w) / sum(w) AS m FROM weighted WHERE w > 0 GROUP BY 1),
ordered AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i FROM means)""", sql="""
SELECT 'favourite_gain' AS name, round(max(m) FILTER (i = 100), 6) AS low, round(max(m) FILTER (i = 3900), 6) AS high
FROM ordered""")
def bootstrap_poisson(spark, sf):
    return rounded(R.bootstrap_interval(evaluated(spark, sf), ["favourite_gain"], "pool_id", R.ANALYSIS_REPLICATES,
                                        method="poisson"))


@query("head_trimmed", ctes=EVAL_SQL, sql="""
SELECT pool_type, count(*) AS n, round(CASE WHEN count(*) <= 3 THEN 0 ELSE
  sum(favourite_gain) FILTER (i > 3) / count(*) END, 6) AS trimmed
FROM (SELECT *, row_number() OVER (PARTITION BY pool_type ORDER BY favourite_gain DESC) AS i FROM evaluated) GROUP BY 1""")
def head_trimmed(spark, sf):
    return rounded(R.head_trimmed(evaluated(spark, sf), "favourite_gain", ["pool_type"]))


@query("split_half", ctes=EVAL_SQL, sql="""
SELECT CASE WHEN i < n_all // 2 THEN 'A' ELSE 'B' END AS half, count(*) AS pools, round(avg(favourite_gain), 6) AS mean_return
FROM (SELECT e.*, row_number() OVER (ORDER BY p.closed_on, e.pool_id) - 1 AS i, count(*) OVER () AS n_all
      FROM evaluated e JOIN pools p USING (pool_id)) GROUP BY 1""")
def split_half(spark, sf):
    # The halves read their rows several times: three columns of every pool, stored once.
    rows = cut_lineage(C.evaluate(V.pools(spark, sf), "closed_on").select("pool_id", "closed_on", "favourite_gain"))
    return rounded(R.split_half(rows, "closed_on", "pool_id").groupBy("half").agg(
        F.count("*").alias("pools"), F.avg("favourite_gain").alias("mean_return")))


@query("histogram_crosscheck", ctes=V.POOLS_SQL, sql="""
SELECT stakes_class, count(*) AS pools, CAST(sum(checked) AS BIGINT) AS ranks_checked,
  CAST(sum(differ) AS BIGINT) AS ranks_different
FROM (SELECT p.pool_id,
    CASE WHEN net_stakes = 0 THEN 'zero' WHEN abs(total * 0.75 - net_stakes) < 0.005 THEN 'exact'
         WHEN abs(total * 0.75 - net_stakes) < net_stakes * 0.01 THEN 'under 1 %' ELSE 'beyond' END AS stakes_class,
    (SELECT count(*) FROM payouts r WHERE r.pool_id = p.pool_id) AS checked,
    (SELECT count(*) FROM payouts r LEFT JOIN crowd c ON c.pool_id = r.pool_id AND c.k = r.rank
      WHERE r.pool_id = p.pool_id AND coalesce(c.slips, -1) <> r.winners) AS differ
  FROM pools p JOIN (SELECT pool_id, sum(slips) AS total FROM crowd GROUP BY 1) t USING (pool_id))
GROUP BY 1""")
def histogram_crosscheck(spark, sf):
    return C.histogram_checks(V.pools(spark, sf)).groupBy("stakes_class").agg(
        F.count("*").alias("pools"), F.sum("ranks_checked").alias("ranks_checked"),
        F.sum("ranks_different").alias("ranks_different"))


@query("carry_over", ctes=V.POOLS_SQL + """,
carried AS (
  SELECT p.pool_id, distributed - coalesce(sum(coalesce(amount * winners, 0)) FILTER (rank < n), 0) / 0.2 AS carry
  FROM pools p LEFT JOIN payouts r USING (pool_id) WHERE distributed IS NOT NULL GROUP BY p.pool_id, distributed)""", sql="""
SELECT count(*) AS n, round(max(carry) FILTER (i = (n_all - 1) // 2), 6) AS median_carry, round(max(carry), 6) AS max_carry
FROM (SELECT carry, row_number() OVER (ORDER BY carry) - 1 AS i, count(*) OVER () AS n_all FROM carried)""")
def carry_over(spark, sf):
    return rounded(C.carry_summary(C.carry_over(V.pools(spark, sf))))


@query("pool_facts", ctes=V.POOLS_SQL, sql="""
SELECT p.pool_type, count(*) AS pools,
  round(CAST(sum(CAST(distributed AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CASE WHEN distributed IS NOT NULL THEN
    CAST(net_stakes AS DECIMAL(18,2)) END) AS DOUBLE), 6) AS given_back,
  round(sum(home) / sum(known), 6) AS home_rate, round(sum(top) / sum(paid), 6) AS top_rank_share
FROM pools p
JOIN (SELECT pool_id, count(*) FILTER (winner = 0) AS home, count(winner) AS known FROM outcomes GROUP BY 1) o USING (pool_id)
JOIN (SELECT r.pool_id, sum(coalesce(amount * winners, 0)) AS paid,
        coalesce(sum(coalesce(amount * winners, 0)) FILTER (rank = n), 0) AS top
      FROM payouts r JOIN pools USING (pool_id) GROUP BY 1) r USING (pool_id)
GROUP BY 1""")
def pool_facts(spark, sf):
    return rounded(C.pool_facts(V.pools(spark, sf)))
