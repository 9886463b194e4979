from pyspark.sql import functions as F

from poolspark.operators import dating as D
from poolspark.operators import market as M
from poolspark.operators.matching import with_team_keys
from poolspark.plans.matching import fixtures
from poolspark.plans.registry import query
from poolspark.sources import views as V

ANCHOR_SQL = V.POOLS_SQL + "," + V.EXT_SQL + """,
met AS (SELECT DISTINCT o.pool_type, o.pool_id, o.ord, e.match_date FROM outcomes o
  JOIN ext e ON e.home_name = o.home AND e.away_name = o.away),
refs AS (SELECT DISTINCT pool_type, pool_id, match_date AS day FROM met),
support AS (SELECT r.pool_type, r.pool_id, r.day, count(DISTINCT m.ord) AS n FROM refs r
  JOIN met m ON m.pool_id = r.pool_id AND date_diff('day', r.day, m.match_date) BETWEEN 0 AND 3 GROUP BY 1, 2, 3),
best AS (SELECT pool_type, pool_id, day, n FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY n DESC, day) AS rn FROM support)
  WHERE rn = 1)"""


def match_keys(spark, sf):
    rows = M.explode_matches(V.pools(spark, sf), "pool_type", "pool_id")
    return with_team_keys(rows.select("pool_type", "pool_id", "ord", "home", "away"))


@query("anchor_days", ctes=ANCHOR_SQL, sql="SELECT * FROM best WHERE n >= 2")
def anchor_days(spark, sf):
    return D.anchors(match_keys(spark, sf), fixtures(spark, sf), D.EXTRA_FIXTURES)


# Anchors of a year-long calendar: days grow with the pool number, a few point to the wrong year.
CALENDAR_SQL = V.POOLS_SQL + """,
dated AS (
  SELECT pool_type, pool_id, CAST(DATE '2014-01-01' + CAST(pool_id // 3 + CASE WHEN pool_id % 23 = 5 THEN 365
    WHEN pool_id % 19 = 4 THEN -7 ELSE pool_id % 4 END AS INT) AS DATE) AS day, 2 + pool_id % 4 AS n FROM pools WHERE pool_id % 5 < 3),
sure AS (SELECT * FROM dated WHERE n >= 3 AND pool_id % 23 <> 5 AND pool_id % 19 <> 4)"""


EVERY_SQL = CALENDAR_SQL.replace(" WHERE pool_id % 5 < 3", "")


def every_day(spark, sf):
    """An anchor for every pool."""
    shift = F.expr("case when pool_id % 23 = 5 then 365L when pool_id % 19 = 4 then -7L else pool_id % 4 end")
    return V.pools(spark, sf).select(
        "pool_type", "pool_id",
        F.date_add(F.lit("2014-01-01").cast("date"), (F.expr("pool_id div 3") + shift).cast("int")).alias("day"),
        (2 + F.col("pool_id") % 4).alias("n"))


def calendar(spark, sf):
    """Two pools in five have no anchor; they are what admission and interpolation fill."""
    return every_day(spark, sf).where("pool_id % 5 < 3")


def sure(spark, sf):
    return calendar(spark, sf).where("n >= 3 and pool_id % 23 != 5 and pool_id % 19 != 4")


ADMIT_SQL = CALENDAR_SQL + """,
merged AS (SELECT d.*, s.pool_id IS NOT NULL AS sure FROM dated d LEFT JOIN sure s USING (pool_type, pool_id)),
near AS (SELECT *, last_value(CASE WHEN sure THEN day END IGNORE NULLS) OVER (PARTITION BY pool_type ORDER BY pool_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(CASE WHEN sure THEN day END IGNORE NULLS) OVER (PARTITION BY pool_type ORDER BY pool_id
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM merged)"""


@query("anchor_admission", ctes=ADMIT_SQL, sql="""
SELECT pool_type, pool_id, day, n, CASE WHEN sure THEN 'squelette' WHEN a IS NULL OR b IS NULL THEN NULL
  WHEN day BETWEEN a AND b THEN 'admise' ELSE 'refusée' END AS verdict FROM near""")
def anchor_admission(spark, sf):
    return D.admit(sure(spark, sf), calendar(spark, sf))


INTERPOLATE_SQL = CALENDAR_SQL + """,
rows AS (SELECT p.pool_type, p.pool_id, s.day, s.n FROM pools p LEFT JOIN sure s USING (pool_type, pool_id)),
near AS (SELECT *,
  last_value(CASE WHEN day IS NOT NULL THEN pool_id END IGNORE NULLS) OVER b AS ai, last_value(day IGNORE NULLS) OVER b AS ad,
  first_value(CASE WHEN day IS NOT NULL THEN pool_id END IGNORE NULLS) OVER f AS bi, first_value(day IGNORE NULLS) OVER f AS bd
  FROM rows WINDOW b AS (PARTITION BY pool_type ORDER BY pool_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    f AS (PARTITION BY pool_type ORDER BY pool_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
estimated AS (
  SELECT pool_type, pool_id, CASE WHEN day IS NOT NULL THEN day WHEN ai IS NOT NULL AND bi IS NOT NULL THEN
      CAST(ad + CAST(round_even(date_diff('day', ad, bd) * ((pool_id - ai) / (bi - ai)), 0) AS INT) AS DATE) END AS date,
    coalesce(day, ad) AS date_min, coalesce(day, bd) AS date_max,
    CASE WHEN day IS NOT NULL THEN 'affiches' WHEN ai IS NOT NULL AND bi IS NOT NULL THEN 'interpolation' ELSE 'hors_ancrage' END AS source,
    CASE WHEN day IS NOT NULL THEN CAST(n AS INT) END AS concordant,
    CASE WHEN day IS NULL AND ai IS NOT NULL AND bi IS NOT NULL THEN CAST(date_diff('day', ad, bd) AS INT) END AS uncertainty FROM near
  WHERE day IS NOT NULL OR ai IS NOT NULL OR bi IS NOT NULL)"""


@query("bracket_interpolation", ctes=INTERPOLATE_SQL, sql="SELECT * FROM estimated")
def bracket_interpolation(spark, sf):
    return D.interpolate(sure(spark, sf), V.pools(spark, sf))


@query("dating_report", ctes=INTERPOLATE_SQL, sql="""
SELECT source, count(*) AS pools, count(*) FILTER (uncertainty <= 3) AS tight, min(date) AS first, max(date) AS last
FROM estimated GROUP BY 1""")
def dating_report(spark, sf):
    return D.dating_report(D.interpolate(sure(spark, sf), V.pools(spark, sf)))


def chain_sql(source: str, name: str) -> str:
    """CTEs that end in ``name``: (pool_type, pool_id) of the longest non-decreasing run of days of ``source``.

    ``tails`` keeps the lowest last day of a run of each length, so it gives the length at every row; the run is then
    followed back from the earliest longest end, each time to the earliest row that is one shorter.
    """
    return f""",
{name}_seq AS MATERIALIZED (SELECT pool_type, pool_id, date_diff('day', DATE '1970-01-01', day) AS d,
  row_number() OVER (PARTITION BY pool_type ORDER BY pool_id) AS i FROM {source}),
{name}_tails AS MATERIALIZED (
  SELECT pool_type, 0::BIGINT AS i, 0::BIGINT AS l, []::BIGINT[] AS t FROM (SELECT DISTINCT pool_type FROM {name}_seq)
  UNION ALL
  SELECT s.pool_type, s.i, CAST(len([x FOR x IN t IF x <= d]) + 1 AS BIGINT), list_concat(list_concat(t[1:len([x FOR x IN t IF x <= d])], [d]),
    t[len([x FOR x IN t IF x <= d]) + 2:]) FROM {name}_tails JOIN {name}_seq s ON s.pool_type = {name}_tails.pool_type AND s.i = {name}_tails.i + 1),
{name}_item AS MATERIALIZED (SELECT pool_type, pool_id, i, d, l FROM {name}_tails JOIN {name}_seq USING (pool_type, i)),
{name}_back AS MATERIALIZED (
  SELECT pool_type, l, i, d FROM (SELECT *, row_number() OVER (PARTITION BY pool_type ORDER BY l DESC, i) AS rn FROM {name}_item) WHERE rn = 1
  UNION ALL
  SELECT x.pool_type, x.l, min(x.i), arg_min(x.d, x.i) FROM {name}_back b JOIN {name}_item x ON x.pool_type = b.pool_type AND x.l = b.l - 1
    AND x.i < b.i AND x.d <= b.d GROUP BY 1, 2),
{name} AS (SELECT pool_type, pool_id FROM {name}_back JOIN {name}_seq USING (pool_type, i))"""


RUN_SQL = EVERY_SQL + chain_sql("dated", "run")


@query("longest_nondecreasing", ctes=RUN_SQL, sql="""
SELECT dated.*, run.pool_id IS NOT NULL AS kept FROM dated LEFT JOIN run USING (pool_type, pool_id)""")
def longest_nondecreasing(spark, sf):
    return D.chronological(every_day(spark, sf), ["pool_type"], "pool_id", "day")


@query("chronology_length", ctes=RUN_SQL, sql="""
SELECT pool_type, CAST(count(run.pool_id) AS BIGINT) AS kept, count(*) AS anchors FROM dated LEFT JOIN run USING (pool_type, pool_id) GROUP BY 1""")
def chronology_length(spark, sf):
    rows = D.chronological(every_day(spark, sf), ["pool_type"], "pool_id", "day")
    return rows.groupBy("pool_type").agg(F.count_if("kept").alias("kept"), F.count("*").alias("anchors"))


TWO_STEP_SQL = (ANCHOR_SQL + ", cand AS MATERIALIZED (SELECT * FROM best WHERE n >= 2), strong AS (SELECT * FROM cand WHERE n >= 3)"
                + chain_sql("strong", "frame") + """,
near AS (SELECT c.*, f.pool_id IS NOT NULL AS sure,
    last_value(CASE WHEN f.pool_id IS NOT NULL THEN day END IGNORE NULLS) OVER (PARTITION BY c.pool_type ORDER BY c.pool_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
    first_value(CASE WHEN f.pool_id IS NOT NULL THEN day END IGNORE NULLS) OVER (PARTITION BY c.pool_type ORDER BY c.pool_id
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b
  FROM cand c LEFT JOIN frame f USING (pool_type, pool_id)),
admitted AS MATERIALIZED (SELECT * FROM near WHERE sure OR day BETWEEN a AND b)""" + chain_sql("admitted", "final"))


@query("two_step_anchors", ctes=TWO_STEP_SQL, sql="""
SELECT a.pool_type, a.pool_id, a.day, a.n FROM admitted a JOIN final USING (pool_type, pool_id)""")
def two_step(spark, sf):
    return D.two_step_anchors(match_keys(spark, sf), fixtures(spark, sf))
