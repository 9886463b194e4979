"""Sinks: rows of other queries written as the stored tables and read back."""

from poolspark.plans.registry import ORACLES, QUERIES, query
from poolspark.sources import readers as R
from poolspark.sources import views as V
from poolspark.sources import writers as W
from poolspark.streaming.runs import workspace

#: Query -> (the query whose rows it stores, how they are written, format).
STORED = {
    "sink_dates": ("bracket_interpolation", W.write_dates, "parquet"),
    "sink_categories": ("category_per_pool", W.write_categories, "parquet"),
    "sink_aliases": ("alias_merge", lambda rows, path: W.write_aliases(rows, path, "league"), "parquet"),
    "sink_compact_prices": ("compact_prices", W.write_compact_prices, "parquet"),
    "sink_index": ("published_index", W.write_index, "json"),
}


def stored(source, write, form):
    def run(spark, sf):
        rows = QUERIES[source](spark, sf)
        path = f"{workspace(spark, 'sink')}/table"
        write(rows, path)
        return spark.read.schema(rows.schema).format(form).load(path).select(*rows.columns)

    return run


for name, (source, write, form) in STORED.items():
    query(name, sql=ORACLES[source])(stored(source, write, form))


@query("sink_prices", ctes=V.POOLS_SQL, sql="""
SELECT match_id, p1, px, p2, source FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY pool_id, line) AS rn FROM outcomes WHERE plausible) WHERE rn = 1""")
def sink_prices(spark, sf):
    rows = V.match_prices(spark, sf).select("match_id", "p1", "px", "p2", "source")
    path = f"{workspace(spark, 'sink')}/table"
    W.write_prices(rows, path)
    return R.lookup(spark, path, "match_id bigint, p1 double, px double, p2 double, source string")


@query("raw_page_scan", sql="SELECT page_id, url, CAST(length(html) AS INT) AS length FROM pages")
def raw_page_scan(spark, sf):
    return R.raw_pages(spark, f"{sf}/pages.parquet").selectExpr("page_id", "url", "length(html) AS length")
