from pyspark.sql import functions as F

from poolspark.operators import slips as S
from poolspark.plans.market import rounded
from poolspark.plans.registry import query
from poolspark.sources import views as V

# Choice sets of a derived multi-slip: one, two or three signs by part, none now and then.
CHOICES = """transform(matches, m -> case when m.mix % 97 = 0 then cast(array() as array<int>)
  when m.part % 3 = 0 then array(cast(m.supp % 3 as int))
  when m.part % 3 = 1 then array_sort(array(cast(m.supp % 3 as int), cast((m.supp + 1) % 3 as int)))
  else array(0, 1, 2) end)"""

CHOICES_SQL = V.POOLS_SQL + """,
signs AS (
  SELECT pool_id, ord, n_legs, s.k AS sign,
    CAST(row_number() OVER (PARTITION BY pool_id, ord ORDER BY s.k) - 1 AS INT) AS pos
  FROM legs, range(0, 3) s(k) WHERE mix % 97 <> 0 AND
    CASE part % 3 WHEN 0 THEN s.k = supp % 3 WHEN 1 THEN s.k = supp % 3 OR s.k = (supp + 1) % 3 ELSE TRUE END),
sizes AS (SELECT pool_id, ord, count(*) AS size FROM signs GROUP BY 1, 2),
full_pools AS (SELECT pool_id, n FROM pools WHERE n = (SELECT count(*) FROM sizes z WHERE z.pool_id = pools.pool_id)),
radix AS (
  SELECT pool_id, ord, size, CAST(coalesce(product(size) OVER (PARTITION BY pool_id ORDER BY ord DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS BIGINT) AS stride
  FROM sizes JOIN full_pools USING (pool_id)),
totals AS (SELECT pool_id, CAST(product(size) AS BIGINT) AS total FROM radix GROUP BY 1),
slips AS (SELECT pool_id, unnest(range(0, total)) AS slip_ix FROM totals),
picks AS (
  SELECT s.pool_id, s.slip_ix, r.ord, g.sign FROM slips s JOIN radix r USING (pool_id)
  JOIN signs g ON g.pool_id = s.pool_id AND g.ord = r.ord AND g.pos = (s.slip_ix // r.stride) % r.size),
texts AS (
  SELECT pool_id, slip_ix, string_agg(CASE sign WHEN 0 THEN '1' WHEN 1 THEN 'N' ELSE '2' END, '' ORDER BY ord) AS t
  FROM picks GROUP BY 1, 2)"""


def composed(spark, sf):
    return V.pools(spark, sf).select("pool_id", "n", F.expr(CHOICES).alias("choices"))


def slips(spark, sf):
    return S.enumerate_slips(composed(spark, sf)).withColumn("t", S.to_text())


@query("slip_count", ctes=CHOICES_SQL, sql="""
SELECT p.pool_id, CAST(count(*) FILTER (size = 1) AS INT) AS singles, CAST(count(*) FILTER (size = 2) AS INT) AS doubles,
  CAST(count(*) FILTER (size = 3) AS INT) AS triples, CAST(count(*) FILTER (size IS NULL) AS INT) AS empties,
  CASE WHEN count(*) FILTER (size IS NULL) > 0 THEN 0 ELSE CAST(product(size) AS BIGINT) END AS slips,
  CAST(CASE WHEN count(*) FILTER (size IS NULL) > 0 THEN 0 ELSE product(size) END AS DOUBLE) AS cost,
  CASE WHEN count(*) FILTER (size IS NULL) > 0 THEN 'empty' WHEN product(size) > 300000 THEN 'refused' ELSE 'listed' END
    AS status
FROM legs p LEFT JOIN sizes z ON z.pool_id = p.pool_id AND z.ord = p.ord GROUP BY 1""")
def slip_count(spark, sf):
    return composed(spark, sf).select("pool_id", *S.summary("choices"), S.enumeration_status("choices").alias("status"))


@query("slip_enumerate", ctes=CHOICES_SQL, sql="""
SELECT p.pool_id, CASE WHEN f.pool_id IS NULL THEN 'empty' WHEN total > 300000 THEN 'refused' ELSE 'listed' END AS status,
  count(t) AS slips, min(t) AS lowest, max(t) AS highest, CAST(sum(slip_ix * (1 + strpos(t, '2'))) AS BIGINT) AS fingerprint
FROM pools p LEFT JOIN full_pools f USING (pool_id) LEFT JOIN totals USING (pool_id) LEFT JOIN texts USING (pool_id) GROUP BY 1, 2""")
def slip_enumerate(spark, sf):
    pools = composed(spark, sf)
    # A multi-slip is listed once, whichever pools hold it. A number keeps the order of its slips' texts: numbers are
    # compared in place, texts would have every slip sorted.
    # They are few bytes but many slips, so they are dealt out to every core.
    different = pools.select("choices").distinct().repartition(spark.sparkContext.defaultParallelism, "choices")
    own = S.enumerate_slips(different).withColumn("t", S.to_text())
    code = F.expr("cast(conv(translate(t, '12N', '012'), 3, 10) as bigint)")
    sums = own.groupBy("choices").agg(
        F.count("*").alias("slips"), F.min(code).alias("low"), F.max(code).alias("high"),
        F.sum(F.expr("slip_ix * (1 + instr(t, '2'))")).alias("fingerprint"))
    text = lambda c: F.expr(f"translate(lpad(conv({c}, 10, 3), size(choices), '0'), '012', '12N')")
    listed = pools.select("pool_id", "choices").join(sums, "choices").select(
        "pool_id", F.lit("listed").alias("status"), "slips", text("low").alias("lowest"), text("high").alias("highest"), "fingerprint")
    others = S.unlisted(composed(spark, sf), ["pool_id"]).select("pool_id", "status", F.lit(0).cast("long").alias("slips"))
    return listed.unionByName(others, allowMissingColumns=True)


@query("slip_preview", ctes=CHOICES_SQL, sql="""
SELECT pool_id, slip_ix, t AS slip, total FROM texts JOIN totals USING (pool_id) WHERE slip_ix < 40""")
def slip_preview(spark, sf):
    return S.preview(composed(spark, sf), ["pool_id"])


MEASURES_SQL = """
measured AS (
  SELECT pool_id, t, count(*) AS slips,
    length(t) - length(replace(t, '1', '')) AS un, length(t) - length(replace(t, 'N', '')) AS nul,
    length(t) - length(replace(t, '2', '')) AS deux,
    list_max([CASE WHEN contains(t, repeat('1', k)) THEN k ELSE 0 END FOR k IN range(0, 8)]) AS suiteUn,
    list_max([CASE WHEN contains(t, repeat('N', k)) THEN k ELSE 0 END FOR k IN range(0, 8)]) AS suiteNul,
    list_max([CASE WHEN contains(t, repeat('2', k)) THEN k ELSE 0 END FOR k IN range(0, 8)]) AS suiteDeux,
    len([i FOR i IN range(1, length(t)) IF t[i] <> t[i+1]]) AS alternances,
    len([i FOR i IN range(1, length(t) // 2 + 1) IF t[i] = t[length(t) + 1 - i]]) AS symetries,
    len([i FOR i IN range(1, length(t) - 1) IF t[i:i+2] IN ('1N2', '2N1')]) AS diagonales,
    len(list_distinct([t[i:i+1] FOR i IN range(1, length(t))])) AS paires,
    len(list_distinct([t[i:i+2] FOR i IN range(1, length(t) - 1)])) AS tierces,
    len(list_distinct([t[i:i+3] FOR i IN range(1, length(t) - 2)])) AS quartes
  FROM texts GROUP BY 1, 2)"""
NAMES = list(S.MEASURES)


@query("slip_measures", ctes=CHOICES_SQL + "," + MEASURES_SQL, sql="SELECT pool_id, " + ", ".join(
    f"CAST(sum({m}) AS BIGINT) AS {m}" for m in NAMES) + " FROM measured GROUP BY 1")
def slip_measures(spark, sf):
    pools = composed(spark, sf).select("pool_id", "choices")
    own = S.enumerate_slips(pools.select("choices").distinct()).select("choices", "picks")
    # Pools hold seven matches at most, so there are few different slips: each is measured once, and so is each multi-slip.
    measured = own.select("picks").distinct().select("picks", *S.measures())
    sums = own.join(F.broadcast(measured), "picks").groupBy("choices").agg(*[F.sum(m).alias(m) for m in NAMES])
    return pools.join(sums, "choices").select("pool_id", *NAMES)


RULES = {"un": {"min": 2}, "nul": {"max": 2}, "suiteDeux": {"max": 2}, "alternances": {"min": 2, "max": 5},
         "paires": {"min": 3}}


@query("slip_rule_filter", ctes=CHOICES_SQL + "," + MEASURES_SQL, sql="""
SELECT pool_id, count(*) AS slips, count(*) FILTER (un >= 2 AND nul <= 2 AND suiteDeux <= 2 AND alternances BETWEEN 2 AND 5
  AND paires >= 3) AS kept, count(*) FILTER (un || '-' || nul || '-' || deux IN ('3-2-2', '2-2-3', '4-1-2')) AS signed
FROM measured GROUP BY 1""")
def slip_rule_filter(spark, sf):
    kept = S.compile_rules(RULES)
    signed = S.compile_rules({"combinaisons": ["3-2-2", "2-2-3", "4-1-2"]})
    return slips(spark, sf).groupBy("pool_id").agg(
        F.count("*").alias("slips"), F.count_if(kept).alias("kept"), F.count_if(signed).alias("signed"))


GROUPS = {"groupes": [{"matchs": [0, 1, 2], "nul": {"max": 1}}, {"matchs": [2, 3, 9], "un": {"min": 1}}, {"matchs": []}]}


@query("slip_group_filter", ctes=CHOICES_SQL, sql="""
SELECT pool_id, count(*) AS slips, count(*) FILTER (
  length(t[1:3]) - length(replace(t[1:3], 'N', '')) <= 1 AND contains(t[3:4], '1')) AS kept FROM texts GROUP BY 1""")
def slip_group_filter(spark, sf):
    return slips(spark, sf).groupBy("pool_id").agg(
        F.count("*").alias("slips"), F.count_if(S.compile_rules(GROUPS)).alias("kept"))


@query("slip_agreement", ctes=CHOICES_SQL, sql="""
SELECT pool_id, hits, count(*) AS slips FROM (
  SELECT p.pool_id, p.slip_ix, CAST(count(*) FILTER (p.sign = o.winner) AS INT) AS hits
  FROM picks p JOIN outcomes o ON o.pool_id = p.pool_id AND o.ord = p.ord
  GROUP BY 1, 2 HAVING bool_and(o.winner IS NOT NULL)) GROUP BY 1, 2""")
def slip_agreement(spark, sf):
    from poolspark.operators.crowd import settled_singly, with_signs

    pools = with_signs(V.pools(spark, sf)).where(settled_singly(F.col("winners")))
    rows = S.enumerate_slips(pools.select("pool_id", "winners", F.expr(CHOICES).alias("choices")))
    return rows.groupBy("pool_id", S.agreement("picks", "winners").alias("hits")).agg(F.count("*").alias("slips"))


@query("choice_presets", ctes=V.POOLS_SQL, sql="""
SELECT pool_id, CAST(CASE WHEN bool_or(p1 IS NULL) THEN 0 ELSE 1 END AS BIGINT) AS favourite_slips,
  CAST(power(3, count(*)) AS BIGINT) AS all_slips, CAST(power(2, count(*)) AS BIGINT) AS home_draw_slips,
  string_agg(CASE WHEN p1 IS NULL THEN '-' WHEN p1 <= px AND p1 <= p2 THEN '0' WHEN px <= p2 THEN '1' ELSE '2' END, ''
    ORDER BY ord) AS favourites FROM legs GROUP BY 1""")
def choice_presets(spark, sf):
    p = S.presets()
    rows = V.pools(spark, sf).select("pool_id", *[c.alias(n) for n, c in p.items()])
    counted = lambda c: F.when(F.expr(f"exists({c}, x -> size(x) = 0)"), F.lit(0).cast("long")).otherwise(S.slip_count(c))
    return rows.select("pool_id", counted("favourite").alias("favourite_slips"), counted("all").alias("all_slips"),
                       counted("home_draw").alias("home_draw_slips"),
                       F.expr("array_join(transform(favourite, c -> coalesce(cast(get(c, 0) as string), '-')), '')")
                       .alias("favourites"))


@query("price_fallback", ctes=V.POOLS_SQL + """,
published AS (
  SELECT match_id, p1, px, p2, source FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY pool_id, line) AS rn FROM outcomes WHERE plausible) WHERE rn = 1)""",
       sql="""
SELECT o.pool_id, o.ord, coalesce(m.p1, CASE WHEN plausible THEN o.p1 END) AS p1,
  coalesce(m.px, CASE WHEN plausible THEN o.px END) AS px, coalesce(m.p2, CASE WHEN plausible THEN o.p2 END) AS p2,
  coalesce(m.source, CASE WHEN plausible THEN '?' END) AS source
FROM outcomes o LEFT JOIN published m ON m.match_id = o.match_id AND o.match_id % 3 <> 0""")
def price_fallback(spark, sf):
    from poolspark.operators.market import explode_matches
    from poolspark.operators.matching import price_fallback as fallback

    rows = explode_matches(V.pools(spark, sf), "pool_id")
    published = V.match_prices(spark, sf).where("match_id % 3 != 0")
    return fallback(rows, published).select("pool_id", "ord", "p1", "px", "p2", "source")


GUARANTEE = 5


def _shaped(spark, sf):
    return composed(spark, sf).withColumn("shape", S.shape())


def _of_pools(pools, kinds):
    """What was found per shape, for every pool of that shape."""
    return pools.join(kinds, "shape").drop("shape")


@query("covering_reduction")
def covering_reduction(spark, sf):
    pools = _shaped(spark, sf)
    kinds = S.reduce_shapes(pools, GUARANTEE).groupBy("shape").agg(
        F.collect_list("slip_ix").alias("kept"), F.max("n_slips").alias("n_slips"), F.max("covered").alias("covered"), F.max("status").alias("status"))
    rows = _of_pools(pools, kinds).select("pool_id", "choices", F.explode_outer("kept").alias("slip_ix"), "n_slips", "covered", "status")
    return rows.withColumn("picks", S.picks_at()).select("pool_id", "slip_ix", S.to_text().alias("slip"), "n_slips", "covered", "status")


COVERED_SQL = f"""
SELECT p.pool_id, CASE WHEN f.pool_id IS NULL THEN 'empty' WHEN total > 8000 THEN 'refused' WHEN p.n < {GUARANTEE} THEN 'none' ELSE 'reduced' END AS status,
  coalesce(total, 0) AS n_slips, CASE WHEN p.n < {GUARANTEE} AND f.pool_id IS NOT NULL THEN 0 ELSE total END AS covered"""


@query("covering_invariant", ctes=CHOICES_SQL, sql=COVERED_SQL + f""",
  CASE WHEN p.n < {GUARANTEE} AND f.pool_id IS NOT NULL THEN 0 ELSE total END AS within
FROM pools p LEFT JOIN full_pools f USING (pool_id) LEFT JOIN totals USING (pool_id)""")
def covering_invariant(spark, sf):
    """A row per pool: what the greedy cover says it covers, and how many slips do share enough signs with a chosen one."""
    shaped = _shaped(spark, sf).select("pool_id", "shape")
    chosen = S.reduce_shapes(shaped, GUARANTEE)
    kinds = chosen.groupBy("shape").agg(F.max("status").alias("status"), F.max("n_slips").alias("n_slips"), F.max("covered").alias("covered"),
                                        F.collect_list("picks").alias("kept"))
    near = F.exists("kept", lambda k: S.agreement_of(F.col("picks"), k) >= GUARANTEE)
    every = S.enumerate_slips(kinds.select("shape", "kept"), "shape")
    within = every.groupBy("shape").agg(F.count_if(near).alias("within"))
    return _of_pools(shaped, kinds.drop("kept").join(within, "shape", "left"))


def _summaries(spark, sf):
    shaped = _shaped(spark, sf).select("pool_id", "shape")
    return _of_pools(shaped, S.reduction_summary(S.reduce_shapes(shaped, GUARANTEE), ["shape"]))


@query("reduction_summary", ctes=CHOICES_SQL, sql="SELECT pool_id, status, n_slips, covered / nullif(n_slips, 0) AS coverage, kept > 0 AS kept_some FROM (" + COVERED_SQL + """
  , CASE WHEN f.pool_id IS NULL OR p.n < 5 OR total > 8000 THEN 0 ELSE 1 END AS kept
FROM pools p LEFT JOIN full_pools f USING (pool_id) LEFT JOIN totals USING (pool_id))""")
def reduction_summary(spark, sf):
    return _summaries(spark, sf).select("pool_id", "status", "n_slips", "coverage", (F.col("kept") > 0).alias("kept_some"))


@query("reduction_savings")
def reduction_savings(spark, sf):
    return rounded(_summaries(spark, sf))
