from pyspark.sql import functions as F

from poolspark.operators import ingest as I
from poolspark.plans.registry import query
from poolspark.sources import views as V

LOG_SQL = """
log AS (
  SELECT user_id % 3 AS pool_type, event_id AS id, CASE WHEN event_id % 400 < 160 THEN 'absent' WHEN event_id % 400 < 240 THEN 'empty'
    WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'absent' WHEN event_type = 'purchase' THEN 'present'
    ELSE 'success' END AS status,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id // 4 % 7 AS VARCHAR) END AS signature FROM events)"""


def log(spark, sf):
    """One entry per event; long stretches of absences and of empty answers among them."""
    stretch = F.col("event_id") % 400
    status = (F.when(stretch < 160, "absent").when(stretch < 240, "empty").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "absent")
              .when(F.col("event_type") == "purchase", "present").otherwise("success"))
    return V.table(spark, sf, "events").select(
        (F.col("user_id") % 3).alias("pool_type"), F.col("event_id").alias("id"), status.alias("status"),
        F.expr("if(event_id % 13 = 0, null, cast((event_id div 4) % 7 as string))").alias("signature"))


def _run_sql(kind):
    return f"""(SELECT *, sum(CASE WHEN status = '{kind}' THEN 1 ELSE 0 END) OVER (PARTITION BY pool_type, run ORDER BY id) AS pos
  FROM (SELECT *, sum(CASE WHEN status <> '{kind}' THEN 1 ELSE 0 END) OVER (PARTITION BY pool_type ORDER BY id) AS run
        FROM log WHERE status <> 'present'))"""


GUARD_SQL = LOG_SQL + f""",
saved AS (SELECT *, lag(coalesce(signature, '')) OVER (PARTITION BY pool_type ORDER BY id) AS prev FROM log WHERE status = 'success'),
seq AS (SELECT *, sum(CASE WHEN coalesce(signature = prev, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY pool_type ORDER BY id) AS run FROM saved),
ident AS (SELECT *, row_number() OVER (PARTITION BY pool_type, run ORDER BY id) AS pos FROM seq),
breaches AS (
  SELECT pool_type, 'error' AS rule, min(id) AS stop_at FROM {_run_sql('error')} WHERE pos >= 5 GROUP BY 1
  UNION ALL SELECT pool_type, 'absent', min(id) FROM {_run_sql('absent')} WHERE pos >= 40 GROUP BY 1
  UNION ALL SELECT pool_type, 'empty', min(id) FROM {_run_sql('empty')} WHERE pos >= 15 GROUP BY 1
  UNION ALL SELECT pool_type, 'identical', min(id) FROM ident WHERE pos >= 3 GROUP BY 1)"""


def breaches(spark, sf):
    rows = log(spark, sf)
    group = ["pool_type"]
    errors = I.first_breach(I.consecutive(rows, group, "id", "status", "error"), group, "id", I.STOP_ERRORS, "error")
    absent = I.first_breach(I.consecutive(rows, group, "id", "status", "absent"), group, "id", I.STOP_ABSENT, "absent")
    empty = I.first_breach(I.consecutive(rows, group, "id", "status", "empty"), group, "id", I.STOP_EMPTY, "empty")
    same = I.first_breach(I.repeated_payloads(rows.where("status = 'success'"), group, "id", "signature"), group, "id",
                          I.STOP_IDENTICAL, "identical")
    return errors.unionByName(absent).unionByName(empty).unionByName(same)


@query("resume_guard_runs", ctes=GUARD_SQL, sql="SELECT * FROM breaches")
def guard_runs(spark, sf):
    return breaches(spark, sf)


@query("resume_range", ctes=GUARD_SQL, sql="""
SELECT b.pool_type, arg_min(rule, stop_at) AS rule, min(stop_at) AS resume_from, any_value(last) AS resume_to
FROM breaches b JOIN (SELECT pool_type, max(id) AS last FROM log GROUP BY 1) l USING (pool_type) GROUP BY 1""")
def resume_range(spark, sf):
    return I.resume_range(log(spark, sf), breaches(spark, sf), ["pool_type"], "id")


@query("recent_ids", ctes=LOG_SQL, sql="""
SELECT pool_type, unnest(range(top - 9, top + 1)) AS id FROM (SELECT pool_type, max(id) AS top FROM log WHERE status = 'success' GROUP BY 1)""")
def recent_ids(spark, sf):
    return I.recent_ids(log(spark, sf).where("status = 'success'"), ["pool_type"], "id", 10)


@query("resume_point", sql="""
SELECT o_orderpriority AS product, min(o_orderkey) AS number, arg_min('/p/' || (o_orderkey - 1), o_orderkey) AS previous
FROM orders GROUP BY 1""")
def resume_point(spark, sf):
    stored = V.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("product"), F.col("o_orderkey").alias("number"),
        F.concat(F.lit("/p/"), (F.col("o_orderkey") - 1).cast("string")).alias("previous"))
    return I.resume_point(stored, ["product"], "number", "previous")


@query("chain_predecessor", sql="""
WITH a AS (SELECT year(o_orderdate) AS season, o_orderkey AS number FROM orders),
s AS (SELECT season, lag(season) OVER (ORDER BY season) AS ps, lag(last) OVER (ORDER BY season) AS pl
  FROM (SELECT season, max(number) AS last FROM a GROUP BY 1)),
p AS (SELECT *, lag(number) OVER (PARTITION BY season ORDER BY number) AS prev FROM a)
SELECT CAST(p.season AS INT) AS season, number, CAST(CASE WHEN prev IS NOT NULL THEN p.season ELSE ps END AS INT) AS prev_season,
  coalesce(prev, pl) AS prev_number FROM p JOIN s USING (season)""")
def chain_predecessor(spark, sf):
    rows = V.table(spark, sf, "orders").select(F.year("o_orderdate").alias("season"), F.col("o_orderkey").alias("number"))
    return I.chain_predecessors(rows, "season", "number")


@query("predecessor_link", sql="""
SELECT o_custkey AS page, coalesce(max(o_orderkey) FILTER (o_orderkey < o_custkey * 40), max(o_orderkey) FILTER (o_orderkey <> o_custkey * 40))
  AS previous FROM orders GROUP BY 1""")
def predecessor_link(spark, sf):
    # A customer's page lists its orders; the number looked from lies below, among or above them. The rule of
    # I.predecessor as two aggregates, so a page with a third of all links is reduced before the shuffle.
    return I.page_predecessor(V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("url"), F.col("o_orderkey").alias("number"),
        (F.col("o_custkey") * 40).alias("wanted")), ["page"], "url", "number", "wanted")
