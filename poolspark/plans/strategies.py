from pyspark.sql import functions as F

from poolspark.operators import slips as S
from poolspark.operators import strategies as X
from poolspark.plans.crowd import MIX_SQL, WEIGHT_SQL
from poolspark.plans.market import rounded
from poolspark.plans.registry import query
from poolspark.sources import views as V

PLAYABLE_SQL = V.POOLS_SQL + """,
base AS (
  SELECT *, (1/p1) / (1/p1+1/px+1/p2) AS q0, (1/px) / (1/p1+1/px+1/p2) AS q1, (1/p2) / (1/p1+1/px+1/p2) AS q2
  FROM outcomes WHERE pool_id IN (SELECT pool_id FROM outcomes GROUP BY 1
    HAVING count(*) = 7 AND bool_and(plausible) AND bool_and(winner IS NOT NULL))),
tops AS (
  SELECT pool_id, ord, winner, greatest(q0, q1, q2) AS pmax,
    CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS fav, q0, q1, q2 FROM base),
ranked AS (
  SELECT pool_id, ord, winner, pmax, fav,
    CASE fav WHEN 0 THEN CASE WHEN q1 >= q2 THEN 1 ELSE 2 END WHEN 1 THEN CASE WHEN q0 >= q2 THEN 0 ELSE 2 END
      ELSE CASE WHEN q0 >= q1 THEN 0 ELSE 1 END END AS sec,
    row_number() OVER (PARTITION BY pool_id ORDER BY pmax DESC, ord) - 1 AS clear,
    row_number() OVER (PARTITION BY pool_id ORDER BY pmax, ord) - 1 AS tight FROM tops),
ranks AS (SELECT pool_id, rank, max(coalesce(amount, 0)) AS amount, max(winners) AS winners FROM payouts GROUP BY 1, 2)"""



def _oracle(strategies):
    """Enumerate every slip of every strategy by index and pay it."""
    cases = []
    for i, s in enumerate(strategies):
        role = s.role.replace("m.", "")
        if role.startswith("if("):
            cond, yes, no = role[3:-1].rsplit(",", 2)
            role = f"CASE WHEN {cond} THEN {yes} ELSE {no} END"
        role = role.replace("D then", " then")
        cases.append(f"WHEN {i} THEN {role}")
    return f""",
roles AS (SELECT r.*, s.i, CASE s.i {' '.join(cases)} END AS role FROM ranked r, range(0, {len(strategies)}) s(i)),
sized AS (SELECT *, CASE role WHEN 'T' THEN 3 WHEN 'D' THEN 2 ELSE 1 END AS size FROM roles),
strided AS (SELECT *, CAST(product(size) OVER w / size AS BIGINT) AS stride,
    CAST(product(size) OVER (PARTITION BY i, pool_id) AS BIGINT) AS total
  FROM sized WINDOW w AS (PARTITION BY i, pool_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
listed AS (SELECT DISTINCT i, pool_id, total FROM strided),
numbered AS (SELECT i, pool_id, unnest(range(0, total)) AS ix FROM listed),
hits AS (
  SELECT i, pool_id, ix, count(*) FILTER (winner = CASE role WHEN 'T' THEN (ix // stride) % 3
    WHEN 'D' THEN CASE WHEN (ix // stride) % 2 = 0 THEN fav ELSE sec END WHEN 'S' THEN sec ELSE fav END) AS h
  FROM numbered JOIN strided USING (i, pool_id) GROUP BY 1, 2, 3),
returned AS (SELECT h.i, h.pool_id, avg(coalesce(r.amount, 0)) AS v FROM hits h
  LEFT JOIN ranks r ON r.pool_id = h.pool_id AND r.rank = h.h GROUP BY 1, 2),
halved AS (SELECT r.*, CASE WHEN dense_rank() OVER (ORDER BY closed_on, pool_id) - 1 <
    (SELECT count(DISTINCT pool_id) FROM returned) // 2 THEN 'A' ELSE 'B' END AS half,
    row_number() OVER (PARTITION BY i ORDER BY v DESC) AS top FROM returned r JOIN pools USING (pool_id)),
scored AS (SELECT i, count(*) AS pools, avg(v) AS mean_return, avg(v) FILTER (half = 'A') AS period_a,
    avg(v) FILTER (half = 'B') AS period_b,
    CASE WHEN count(*) <= 3 THEN 0 ELSE sum(v) FILTER (top > 3) / count(*) END AS without_head FROM halved GROUP BY 1)"""


def _values(strategies, *fields):
    rows = []
    for i, s in enumerate(strategies):
        cells = [str(i)]
        for f in fields:
            v = getattr(s, f)
            cells.append(f"'{v}'" if isinstance(v, str) else ("NULL" if v is None else str(v)))
        rows.append(f"({', '.join(cells)})")
    return f"(VALUES {', '.join(rows)}) lab(i, {', '.join(fields)})"


@query("strategy_scoreboard", ctes=PLAYABLE_SQL + _oracle(X.SCOREBOARD) + f""",
hashed AS (SELECT b, ix, {MIX_SQL} AS u FROM (SELECT DISTINCT pool_id AS ix FROM returned), range(0, 3000) r(b)),
weighted AS (SELECT b, ix, {WEIGHT_SQL} AS w FROM hashed),
means AS (SELECT i, b, sum(v * w) / sum(w) AS m FROM weighted JOIN returned ON pool_id = ix WHERE w > 0 GROUP BY 1, 2),
ordered AS (SELECT i, m, row_number() OVER (PARTITION BY i ORDER BY m) - 1 AS r FROM means),
ci AS (SELECT i, max(m) FILTER (r = 75) AS low, max(m) FILTER (r = 2925) AS high FROM ordered GROUP BY 1)""", sql=f"""
SELECT name, CAST(cost AS INT) AS cost, pools, round(mean_return, 6) AS mean_return, round(period_a, 6) AS period_a,
  round(period_b, 6) AS period_b, round(low, 6) AS low, round(high, 6) AS high, round(without_head, 6) AS without_head
FROM scored JOIN ci USING (i) JOIN {_values(X.SCOREBOARD, "name", "cost")} USING (i)""")
def strategy_scoreboard(spark, sf):
    return rounded(X.scoreboard(V.pools(spark, sf)))


_PAIRS = [s for t, d in X.PLACEMENTS for s in (X.system(d, t, X.CLEAR), X.system(d, t, X.TIGHT))]


@query("placement_comparison", ctes=PLAYABLE_SQL + _oracle(_PAIRS), sql=f"""
SELECT CAST(triples AS INT) AS triples, CAST(doubles AS INT) AS doubles, CAST(cost AS INT) AS slips,
  round(max(mean_return) FILTER (i % 2 = 0), 6) AS clear_return, round(max(mean_return) FILTER (i % 2 = 1), 6) AS tight_return,
  round((max(mean_return) FILTER (i % 2 = 0) - max(mean_return) FILTER (i % 2 = 1)) * 100, 6) AS gap
FROM scored JOIN {_values(_PAIRS, "triples", "doubles", "cost")} USING (i) GROUP BY 1, 2, 3""")
def placement_comparison(spark, sf):
    return rounded(X.placement_comparison(V.pools(spark, sf)))


_CURVE = [X.system(d, 0) for d in X.SIZE_CURVE]


@query("size_curve", ctes=PLAYABLE_SQL + _oracle(_CURVE), sql=f"""
SELECT CAST(doubles AS INT) AS doubles, CAST(cost AS INT) AS cost, round(mean_return, 6) AS mean_return,
  round(period_a, 6) AS period_a, round(period_b, 6) AS period_b, round(without_head, 6) AS without_head,
  round((mean_return - 1) * cost, 6) AS expected_gain,
  round(1 + ((mean_return - 1) * cost - lag((mean_return - 1) * cost) OVER (ORDER BY i))
    / (cost - lag(cost) OVER (ORDER BY i)), 6) AS marginal
FROM scored JOIN {_values(_CURVE, "doubles", "cost")} USING (i)""")
def size_curve(spark, sf):
    return rounded(X.size_curve(V.pools(spark, sf)))


_CONFIGS = X.configurations()


@query("config_sweep", ctes=PLAYABLE_SQL + _oracle(_CONFIGS), sql=f"""
SELECT CAST(7 - doubles - triples AS INT) AS bases, CAST(doubles AS INT) AS doubles, CAST(triples AS INT) AS triples,
  CASE WHEN triples = 0 THEN '—' ELSE triples_on END AS triples_on, CAST(cost AS INT) AS cost,
  round(mean_return, 6) AS mean_return, round((mean_return - 1) * cost, 6) AS expected_gain, round(period_a, 6) AS period_a,
  round(period_b, 6) AS period_b, round(without_head, 6) AS without_head
FROM scored JOIN {_values(_CONFIGS, "doubles", "triples", "cost", "triples_on")} USING (i)""")
def config_sweep(spark, sf):
    return rounded(X.config_sweep(V.pools(spark, sf)))


MECHANISM_SQL = PLAYABLE_SQL + """,
mech AS (SELECT r.winner = r.fav AS favourite_won, a.amount, a.winners FROM ranked r
  JOIN ranks a ON a.pool_id = r.pool_id AND a.rank = 7 WHERE clear = 0)"""


@query("mechanism_split", ctes=MECHANISM_SQL, sql="""
SELECT favourite_won, count(*) AS pools, round(avg(amount), 6) AS mean_amount, round(median(amount), 6) AS median_amount,
  round(CAST(median(winners) AS DOUBLE), 6) AS median_winners FROM mech GROUP BY 1""")
def mechanism_split(spark, sf):
    return rounded(X.mechanism_split(V.pools(spark, sf)))


@query("mechanism_summary", ctes=MECHANISM_SQL, sql="""
SELECT round(d, 6) AS drop_rate, round(f, 6) AS factor, round((1 - d) / d, 6) AS chance_cost,
  round(f * d / (1 - d), 6) AS relative_expectation
FROM (SELECT avg(CASE WHEN favourite_won THEN 0.0 ELSE 1.0 END) AS d,
  avg(amount) FILTER (NOT favourite_won) / avg(amount) FILTER (favourite_won) AS f FROM mech)""")
def mechanism_summary(spark, sf):
    return rounded(X.mechanism_summary(V.pools(spark, sf)))


@query("playable_pools", ctes=PLAYABLE_SQL, sql="""
SELECT pool_id, string_agg(fav, '' ORDER BY ord) AS favourites, string_agg(sec, '' ORDER BY ord) AS seconds,
  string_agg(clear, '' ORDER BY ord) AS clearest, string_agg(tight, '' ORDER BY ord) AS tightest,
  round(max(pmax), 6) AS pmax FROM ranked GROUP BY 1""")
def playable(spark, sf):
    joined = lambda f: F.expr(f"array_join(transform(ranked, m -> cast(m.{f} as string)), '')")
    return rounded(X.playable(V.pools(spark, sf)).select(
        "pool_id", joined("favourite").alias("favourites"), joined("second").alias("seconds"),
        joined("clear").alias("clearest"), joined("tight").alias("tightest"),
        F.expr("array_max(transform(ranked, m -> m.pmax))").alias("pmax")))


_ENUMERATED = [X.system(2, 1, X.CLEAR, X.TIGHT), X.adaptive(0.55)]


@query("strategy_enumerated", ctes=PLAYABLE_SQL + _oracle(_ENUMERATED), sql="""


SELECT CAST(h.i AS INT) AS strategy, h.pool_id, count(*) AS slips, round(avg(coalesce(r.amount, 0)), 6) AS payout
FROM hits h LEFT JOIN ranks r ON r.pool_id = h.pool_id AND r.rank = h.h GROUP BY 1, 2""")
def strategy_enumerated(spark, sf):
    """The same payouts slip by slip: choice sets, enumeration, hits, rank amounts."""
    played = X.playable(V.pools(spark, sf))
    chosen = played.select("pool_id", "amounts", F.expr("transform(ranked, m -> m.w)").alias("winners"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("strategy"), X.choice_sets(s).alias("choices")) for i, s in enumerate(_ENUMERATED)])).alias("c"))
    slips = S.enumerate_slips(chosen.select("pool_id", "amounts", "winners", "c.*"))
    paid = F.coalesce(F.try_element_at("amounts", S.agreement("picks", "winners")), F.lit(0.0))
    return rounded(slips.groupBy("strategy", "pool_id").agg(F.count("*").alias("slips"), F.avg(paid).alias("payout")))
