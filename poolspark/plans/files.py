"""Stored forms: documents written as files, read back through their reader, and reports beside the screen."""

from pyspark.sql import functions as F

from poolspark.functions import text as T
from poolspark.operators import audit as A
from poolspark.operators import entity as E
from poolspark.operators.market import explode_matches
from poolspark.plans.registry import ORACLES, QUERIES, query
from poolspark.sources import readers as R
from poolspark.sources import views as V
from poolspark.sources import writers as W
from poolspark.streaming.runs import workspace


def folder(spark, name):
    return f"{workspace(spark, name)}/table"


@query("feed_pool_scan", ctes=V.POOLS_SQL, sql="""
SELECT pool_id, pool_type, net_stakes, has_code, n AS matches FROM pools""")
def feed_pool_scan(spark, sf):
    """Feed documents (JSON), compacted to parquet by type, read again."""
    documents, compacted = folder(spark, "feed"), folder(spark, "compacted")
    V.pools(spark, sf).select("pool_id", "pool_type", "status", "net_stakes", "result_code", F.expr(
        "transform(matches, m -> named_struct('match_id', m.match_id, 'home', m.home, 'away', m.away, 'p1', m.p1))").alias("matches")).write.json(documents)
    W.write_compacted(R.feed_pools(spark, documents), compacted)
    return spark.read.parquet(compacted).select(
        "pool_id", F.col("pool_type").cast("int").alias("pool_type"), "net_stakes", F.col("result_code").isNotNull().alias("has_code"), F.size("matches").alias("matches"))


@query("archive_pool_scan", ctes=V.POOLS_SQL, sql="""
SELECT CAST(pool_id AS INT) AS numero, CAST(n_legs AS INT) AS matchs, CAST(count(*) FILTER (code IN ('100', '010', '001')) AS INT) AS issues,
  string_agg(home, '|' ORDER BY ord) AS homes FROM legs GROUP BY 1, 2""")
def archive_pool_scan(spark, sf):
    path = folder(spark, "archive")
    V.pools(spark, sf).select(F.lit("grille7").alias("produit"), F.col("pool_id").alias("numero"), F.expr("""transform(matches, m -> named_struct(
        'home', m.home, 'away', m.away, 'issue', case m.code when '100' then '1' when '010' then 'N' when '001' then '2' end))""").alias("matchs")).write.json(path)
    return R.archive_pools(spark, path).select("numero", F.size("matchs").alias("matchs"), F.expr("size(filter(matchs, m -> m.issue is not null))").alias("issues"),
                                               F.expr("array_join(transform(matchs, m -> m.home), '|')").alias("homes"))


@query("page_pool_scan", sql="""
SELECT 'x' || o_orderkey % 3 AS grille_type, count(*) AS pools, CAST(sum(o_orderkey) AS BIGINT) AS numbers, CAST(0 AS BIGINT) AS unreadable FROM orders GROUP BY 1""")
def page_pool_scan(spark, sf):
    """Page-form documents, one object a line; none is unreadable."""
    path = folder(spark, "page")
    V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("grille_id"), F.concat(F.lit("x"), F.col("o_orderkey") % 3).alias("grille_type"),
                                        F.array(F.struct(F.lit("A").alias("home"), F.lit("B").alias("away"))).alias("matches")).write.json(path)
    pools, bad = R.page_pools(spark, path, lines=True)
    found = pools.groupBy("grille_type").agg(F.count("*").alias("pools"), F.sum("grille_id").alias("numbers"))
    return found.withColumn("unreadable", bad.agg(F.count("*")).scalar())


@query("fixture_days_scan", ctes=V.LEGS_SQL + "," + V.EXT_SQL, sql="""
SELECT match_date, count(DISTINCT home_name || '/' || away_name) AS pairs FROM ext GROUP BY 1""")
def fixture_days_scan(spark, sf):
    fixtures = V.ext_fixtures(spark, sf).select(T.fold("home_name").alias("home_key"), T.fold("away_name").alias("away_key"), "match_date")
    return R.fixture_days(fixtures).distinct().groupBy("match_date").agg(F.count("*").alias("pairs"))


@query("frame_file_scan", sql="""
SELECT kind, count(DISTINCT id) AS entries FROM (
  SELECT 'pool' AS kind, 7000000 + user_id % 20 AS id FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0
  UNION ALL SELECT 'match', user_id FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0) GROUP BY 1""")
def frame_file_scan(spark, sf):
    from poolspark.plans.streams import frames
    from poolspark.streaming import frames as X

    path = folder(spark, "frames")
    frames(V.table(spark, sf, "events")).select(F.col("body").alias("value")).write.text(path)
    return X.entries(R.frames(spark, path), "body", "seq").groupBy("kind").agg(F.countDistinct("id").alias("entries"))


@query("report_screen", sql="SELECT *, FALSE AS clean, (SELECT count(*) FROM (" + ORACLES["id_gaps"] + ")) AS written FROM (" + ORACLES["id_gaps"] + """)
ORDER BY first_missing, last_missing LIMIT 40""")
def report_screen(spark, sf):
    """The whole report on disk, its first lines for the screen, and whether there was anything to report."""
    rows = QUERIES["id_gaps"](spark, sf)
    path = folder(spark, "report")
    shown = W.write_report(rows, path, 40, "first_missing", "last_missing")
    written = spark.read.schema(rows.schema).json(path)
    return shown.withColumn("clean", F.lit(A.is_clean(written))).withColumn("written", written.agg(F.count("*")).scalar())


@query("slip_lines", ctes=V.POOLS_SQL, sql="""
SELECT t AS value, count(*) AS slips FROM (SELECT pool_id, string_agg(CASE part % 3 WHEN 0 THEN '1' WHEN 1 THEN 'N' ELSE '2' END, '' ORDER BY ord) AS t FROM legs GROUP BY 1)
GROUP BY 1""")
def slip_lines(spark, sf):
    path = folder(spark, "slips")
    W.write_slips(V.pools(spark, sf).select(F.expr("transform(matches, m -> cast(m.part % 3 as int))").alias("picks")), path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("slips"))


@query("name_spelling", ctes=V.POOLS_SQL, sql="""
SELECT part % 211 AS number, arg_min(CASE WHEN part % 2 = 0 THEN upper(home) ELSE home END, pool_id * 100 + ord) AS display FROM legs GROUP BY 1""")
def name_spelling(spark, sf):
    """Of the spellings of a name the one seen first is shown."""
    rows = explode_matches(V.pools(spark, sf), "pool_id").select("pool_id", "ord", F.when(F.col("part") % 2 == 0, F.upper("home")).otherwise(F.col("home")).alias("home_name"))
    found = E.distinct_names(rows, ["pool_id", "ord"], ["home_name"])
    return found.select(F.regexp_extract("display", r"(\d+)", 1).cast("long").alias("number"), "display")
