from pyspark.sql import functions as F

from poolspark.functions.prices import plausible_market
from poolspark.operators import category as K
from poolspark.operators import publish as U
from poolspark.operators.matching import keep_last_plausible
from poolspark.plans.category import named_of
from poolspark.plans.publish import INDEX_SQL
from poolspark.plans.registry import query
from poolspark.session import cut_lineage
from poolspark.sources import views as V
from poolspark.sources.versions import Versions, last_observations
from poolspark.streaming import frames as X
from poolspark.streaming import runs as S


def stream(spark, sf, name):
    """A table of the star schema as a file stream."""
    # A glob, so that the table may be one file or a folder.
    return spark.readStream.schema(V.table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


# One frame per event: a pool of three matches and one match entry, some entries null, some noise.
FRAME_SQL_SPARK = """case when event_id % 11 = 0 then '3probe' when event_id % 13 = 0 then concat('42["m",{"pools":{"',
    7000000 + user_id % 20, '":null}}]')
  else concat('42["m",{"pools":{"', 7000000 + user_id % 20, '":{"poolId":', 7000000 + user_id % 20, ',"poolStatus":"', event_type,
    '","matches":[', array_join(transform(sequence(0, 2), k -> cast(user_id % 20 * 9 + k * 3 as string)), ','), ']}},"matches":{"',
    user_id, '":{"matchId":', user_id, ',"regularScore1":', event_id % 5, ',"competitor1Name":"T', event_id % 7, '"}}}]') end"""

ENTRY_SQL = """
good AS (SELECT *, 7000000 + user_id % 20 AS pool FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0),
pools AS (SELECT pool, arg_max(event_type, event_id) AS status FROM good GROUP BY 1),
matches AS (SELECT user_id AS match_id, max(event_id) AS seq FROM good GROUP BY 1),
expected AS (SELECT pool, (pool - 7000000) * 9 + k * 3 AS match_id FROM pools, range(0, 3) r(k)),
gate AS (SELECT pool, count(*) AS expected, count(m.match_id) AS received FROM expected LEFT JOIN matches m USING (match_id) GROUP BY 1)"""


def frames(df):
    return df.select(F.col("event_id").alias("seq"), F.expr(FRAME_SQL_SPARK).alias("body"))


@query("frames_decode_batch", ctes=ENTRY_SQL, sql="""
SELECT 'pool' AS kind, pool AS id, status AS state FROM pools
UNION ALL SELECT 'match', match_id, 'T' || seq % 7 FROM matches""")
def frames_batch(spark, sf):
    rows = X.accumulate(X.entries(frames(V.table(spark, sf, "events")), "body", "seq"))
    return _states(rows)


def _states(rows):
    return rows.select("kind", "id", F.when(F.col("kind") == "pool", F.get_json_object("payload", "$.poolStatus"))
                       .otherwise(F.get_json_object("payload", "$.competitor1Name")).alias("state"))


@query("stream_frames_accumulate", ctes=ENTRY_SQL, sql="""
SELECT 'pool' AS kind, pool AS id, status AS state FROM pools
UNION ALL SELECT 'match', match_id, 'T' || seq % 7 FROM matches""")
def stream_accumulate(spark, sf):
    return _states(S.accumulate_frames(frames(stream(spark, sf, "events"))))


@query("frames_completeness", ctes=ENTRY_SQL, sql="""
SELECT pool AS global_id, expected, received, expected = received AS complete FROM gate""")
def frames_completeness(spark, sf):
    return X.completeness(X.accumulate(X.entries(frames(V.table(spark, sf, "events")), "body", "seq")))


@query("stream_completeness", ctes=ENTRY_SQL, sql="""
SELECT g.pool AS global_id, g.pool - 7000000 AS pool_id, CAST(7 AS INT) AS pool_type, p.status,
  string_agg('T' || m.seq % 7 || ':' || m.seq % 5, ' ' ORDER BY e.match_id) AS lines
FROM gate g JOIN pools p USING (pool) JOIN expected e USING (pool) JOIN matches m USING (match_id) WHERE expected = received GROUP BY 1, 2, 3, 4""")
def stream_complete(spark, sf):
    rows = S.emit_complete(frames(stream(spark, sf, "events")))
    return rows.select("global_id", "pool_id", "pool_type", "status", F.expr(
        "array_join(transform(matches, m -> concat(m.home, ':', m.score_home)), ' ')").alias("lines"))


KEPT_SQL = V.SNAPSHOTS_SQL + """,
kept AS (SELECT pool_id, match_id, max(seq) AS last_seq, max(seq) FILTER (ok) AS good_seq FROM judged GROUP BY 1, 2)"""
KEPT = """
SELECT k.pool_id, k.match_id, coalesce(g.p1, l.p1) AS p1, coalesce(g.px, l.px) AS px, coalesce(g.p2, l.p2) AS p2,
  CASE WHEN good_seq <> last_seq THEN g.collected_at END AS observed_at, l.collected_at
FROM kept k JOIN judged l ON l.seq = last_seq LEFT JOIN judged g ON g.seq = good_seq"""


@query("stream_keep_plausible", ctes=KEPT_SQL, sql=KEPT)
def stream_keep(spark, sf):
    return S.keep_plausible(V.snapshots_of(stream(spark, sf, "events")))


@query("stream_activity_windows", sql="""
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
FROM events GROUP BY 1, 2""")
def stream_activity(spark, sf):
    events = stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.activity(events, "ts", "1 hour", "10 minutes", "event_type")


def in_parts(spark, rows, part, n, name):
    """The rows as a stream of ``n`` micro-batches, few more where parts are written to fewer files: part after part."""
    folder = f"{S.workspace(spark, name)}/in"
    files = [0]
    for k in range(n):
        rows.where(part == k).write.mode("append").parquet(folder)
        files.append(len(spark.read.schema(rows.schema).parquet(folder).inputFiles()))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_at_once(files)).parquet(folder)


def files_at_once(files):
    """Files of a micro-batch, from the numbers of files after each part: the largest part, less where that made too few batches."""
    n, total = len(files) - 1, files[-1]
    most = max(1, *[b - a for a, b in zip(files, files[1:])])
    return most if -(-total // most) >= n else max(1, total // n)


LINES_SQL = """
SELECT g.pool AS global_id, {status} AS status, string_agg('T' || m.seq % 7 || ':' || m.seq % 5, ' ' ORDER BY e.match_id) AS lines
FROM gate g JOIN pools p USING (pool) JOIN expected e USING (pool) JOIN matches m USING (match_id) WHERE expected = received GROUP BY 1, 2"""


def _lines(rows):
    return rows.select("global_id", "status", F.expr("array_join(transform(matches, m -> concat(m.home, ':', m.score_home)), ' ')").alias("lines"))


@query("stream_completeness_batches", ctes=ENTRY_SQL, sql=LINES_SQL.format(status="p.status"))
def stream_complete_batches(spark, sf):
    """Frames in several micro-batches, out of order: what a pool waits for is kept in its state."""
    rows = frames(V.table(spark, sf, "events"))
    return _lines(S.emit_complete(in_parts(spark, rows, F.pmod(F.lit(3) - F.col("seq"), F.lit(3)), 3, "frames")))


@query("stream_completeness_settled", ctes=ENTRY_SQL, sql=LINES_SQL.format(status="'ENDED'"))
def stream_complete_settled(spark, sf):
    """A last frame settles every pool: it is stored a last time and its state ends."""
    rows = frames(V.table(spark, sf, "events"))
    last = rows.groupBy(F.regexp_extract("body", r'"poolId":(\d+)', 1).alias("pool"), F.regexp_extract("body", r'"matches":\[([0-9,]+)\]', 1).alias("ids")).agg(
        F.max("seq").alias("seq")).where("pool != ''")
    closing = last.select((F.col("seq") + 10**12).alias("seq"), F.concat(
        F.lit('42["m",{"pools":{"'), "pool", F.lit('":{"poolId":'), "pool", F.lit(',"poolStatus":"ENDED","matches":['), "ids", F.lit("]}}}]")).alias("body"))
    both = rows.select("seq", "body", F.lit(0).alias("part")).unionByName(closing.withColumn("part", F.lit(1)))
    return _lines(S.emit_complete(in_parts(spark, both, F.col("part"), 2, "frames").drop("part"), settled=("ENDED",)))


@query("stream_index_refresh", ctes=INDEX_SQL, sql="SELECT * FROM indexed")
def stream_index(spark, sf):
    """Every pool comes in three parts, in three micro-batches; the index ends as the one built at once."""
    # Every micro-batch joins the same prices.
    orders, prices = V.table(spark, sf, "orders"), cut_lineage(V.match_prices(spark, sf))

    def build(lines):
        pools = V.pools_of(V.legs_of(lines), orders)
        return U.published_index(pools, prices, K.categorise(named_of(pools)))

    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    stream_of = in_parts(spark, lines, F.col("l_linenumber") % 3, 3, "lines")
    rows = S.refresh_index(stream_of, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"], F.expr("l_orderkey div 4"), build)
    paid = F.expr("array_join(transform(rapports, r -> concat(r.rank, ':', r.winners)), ' ')")
    return rows.withColumn("rapports", paid).select(*U.INDEX_FIELDS)


def snapshot_table(spark, sf):
    """The price history of all events, written in three parts, compacted after the second."""
    ok = plausible_market("p1", "px", "p2")
    rows = V.snapshots(spark, sf)
    table = Versions(spark, f"{S.workspace(spark, 'snapshots')}/table", rows.schema, ["pool_id", "match_id"], last_observations(["pool_id", "match_id"], "seq", ok))
    for version in range(3):
        table.append(rows.where(F.col("seq") % 3 == version), version)
        if version == 1:
            table.compact(1)
    return table


@query("snapshot_upsert", ctes=KEPT_SQL, sql=KEPT)
def snapshot_upsert(spark, sf):
    """Latest view of the snapshot table: base of the first two versions and the log after it, prices retained."""
    return keep_last_plausible(snapshot_table(spark, sf).rows(), ["pool_id", "match_id"], ["seq"])


@query("snapshot_history", sql="""
SELECT user_id % 20 AS pool_id, user_id AS match_id, event_id % 3 AS version, count(*) AS rows, min(event_id) AS first, max(event_id) AS last
FROM events GROUP BY 1, 2, 3""")
def snapshot_history(spark, sf):
    return snapshot_table(spark, sf).history().groupBy("pool_id", "match_id", F.col("version").cast("long").alias("version")).agg(
        F.count("*").alias("rows"), F.min("seq").alias("first"), F.max("seq").alias("last"))
