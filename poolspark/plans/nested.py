from pyspark.sql import functions as F

from poolspark.functions import nested as N
from poolspark.plans.registry import query
from poolspark.sources import views as V


def objects(spark, sf):
    return V.table(spark, sf, "events").select("event_id", "user_id", F.expr("parse_json(props)").alias("object"))


@query("json_key_inventory", sql="""
SELECT key, count(*) AS present, count(*) FILTER (json_extract(props, '$.' || key) IS NOT NULL
  AND CAST(json_extract(props, '$.' || key) AS VARCHAR) NOT IN ('null', '""', '[]', '{}')) AS filled
FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY 1""")
def inventory(spark, sf):
    return N.key_inventory(objects(spark, sf))


@query("population_split", sql="""
SELECT user_id % 7 = 0 AS member, key, count(*) AS present, count(*) FILTER (json_extract(props, '$.' || key) IS NOT NULL
  AND CAST(json_extract(props, '$.' || key) AS VARCHAR) NOT IN ('null', '""', '[]', '{}')) AS filled
FROM (SELECT user_id, props, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2""")
def population(spark, sf):
    members = V.table(spark, sf, "events").where("user_id % 7 = 0").select("user_id")
    return N.key_inventory(N.split_population(objects(spark, sf), members, ["user_id"]), by=["member"])


# A payload per pool: matches by id with their prices under unknown names, next to other numbers.
PAYLOAD = """to_json(named_struct('pools', named_struct('id', pool_id), 'matches', transform(matches, m -> named_struct(
  'id', m.match_id + 1000, 'odds', named_struct('a', m.p1, 'b', m.px, 'c', m.p2), 'line', m.line))))"""


def payloads(spark, sf):
    pools = V.pools(spark, sf, ["line", "match_id", "p1", "px", "p2", "code"])
    return pools.select("pool_id", F.expr(f"parse_json({PAYLOAD})").alias("payload"))


@query("payload_walk", ctes=V.POOLS_SQL, sql="""
SELECT path, count(*) AS objects FROM (
  SELECT unnest(['matches[' || ord || ']', 'matches[' || ord || '].odds']) AS path FROM legs
  UNION ALL SELECT unnest(['', 'pools']) FROM pools) GROUP BY 1""")
def payload_walk(spark, sf):
    return N.walk(payloads(spark, sf), ["pool_id"], "payload").groupBy("path").agg(F.count("*").alias("objects"))


@query("market_signature_scan", ctes=V.POOLS_SQL, sql="""
SELECT pool_id, 'matches[' || ord || '].odds' AS path, p1 AS v1, px AS v2, p2 AS v3, round(1/p1 + 1/px + 1/p2, 4) AS margin
FROM legs WHERE p1 BETWEEN 1.01 AND 100 AND px BETWEEN 1.01 AND 100 AND p2 BETWEEN 1.01 AND 100
  AND 1/p1 + 1/px + 1/p2 BETWEEN 1.0 AND 1.4""")
def signature_scan(spark, sf):
    found = N.payload_markets(payloads(spark, sf), ["pool_id"], "payload")
    return found.select("pool_id", "path", "v1", "v2", "v3", "margin")


@query("suspect_triples_screen", ctes=V.POOLS_SQL, sql="""
SELECT pool_id, 'matches[' || ord || '].odds' AS path, round(1/p1 + 1/px + 1/p2, 4) AS margin FROM legs
WHERE p1 BETWEEN 1.01 AND 100 AND px BETWEEN 1.01 AND 100 AND p2 BETWEEN 1.01 AND 100 AND 1/p1 + 1/px + 1/p2 BETWEEN 1.0 AND 1.4
ORDER BY margin, pool_id, path LIMIT 20""")
def suspects(spark, sf):
    found = N.payload_markets(payloads(spark, sf), ["pool_id"], "payload")
    return found.select("pool_id", "path", "margin").orderBy("margin", "pool_id", "path").limit(20)


# A payload per pool whose matches carry null, "", [], {} and filled values under several keys.
FILLED = """concat('{"matches":[', array_join(transform(matches, m -> concat('{"id":', m.match_id,
  ',"note":', case m.mix % 3 when 0 then 'null' when 1 then '""' else '"x"' end, ',"marks":', if(m.mix % 2 = 0, '[]', '[1,[{"z":null}]]'),
  ',"meta":', if(m.mix % 5 = 0, '{}', '{"k":0}'), '}')), ','), ']}')"""


@query("payload_key_inventory", ctes=V.POOLS_SQL, sql="""
SELECT key, count(*) AS present, count(*) FILTER (filled) AS filled FROM (
  SELECT 'matches' AS key, true AS filled FROM pools
  UNION ALL SELECT 'id', true FROM legs UNION ALL SELECT 'note', mix % 3 = 2 FROM legs
  UNION ALL SELECT 'marks', mix % 2 <> 0 FROM legs UNION ALL SELECT 'z', false FROM legs WHERE mix % 2 <> 0
  UNION ALL SELECT 'meta', mix % 5 <> 0 FROM legs UNION ALL SELECT 'k', true FROM legs WHERE mix % 5 <> 0) GROUP BY 1""")
def payload_key_inventory(spark, sf):
    bodies = V.pools(spark, sf).select("pool_id", F.expr(f"parse_json({FILLED})").alias("payload"))
    return N.key_inventory(N.walk(bodies, ["pool_id"], "payload"))


RESTRICTED = """transform(matches, m -> named_struct('home', m.home, 'issue', m.code,
  'public', if(m.mix % 4 = 0, null, array(m.p1, m.px, m.p2))))"""


@query("drop_restricted_fields", ctes=V.POOLS_SQL, sql="""
SELECT pool_id, CAST(count(*) FILTER (mix % 4 <> 0) + CASE WHEN pool_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS removed,
  0 AS removed_again, string_agg(home, '|' ORDER BY ord) AS homes FROM legs GROUP BY 1""")
def drop_restricted(spark, sf):
    archive = V.pools(spark, sf).select("pool_id", F.expr(RESTRICTED).alias("matchs"),
                                        F.expr("if(pool_id % 3 = 0, size(matches), null)").alias("public_connu"))
    once = N.drop_restricted(archive).withColumnRenamed("removed", "first_removed")
    again = N.drop_restricted(once)
    return again.select("pool_id", F.col("first_removed").alias("removed"), F.col("removed").alias("removed_again"),
                        F.expr("array_join(transform(matchs, m -> m.home), '|')").alias("homes"))


NAMES = ["the", "<b>", "eau", "sch", "ión"]


@query("payload_search", sql="""
SELECT page_id, CAST(n AS INT) AS found, length FROM (
  SELECT page_id, CAST(length(html) AS INT) AS length, len([x FOR x IN ['the', '<b>', 'eau', 'sch', 'ión'] IF contains(html, x)]) AS n
  FROM pages) WHERE n >= 2""")
def payload_search(spark, sf):
    rows = N.payloads_naming(V.table(spark, sf, "pages"), "html", NAMES)
    return rows.select("page_id", F.size("found").alias("found"), "length")


@query("largest_payloads", sql="""
SELECT page_id, CAST(length(html) AS INT) AS length FROM pages ORDER BY length DESC, page_id LIMIT 15""")
def largest(spark, sf):
    return N.largest_payloads(V.table(spark, sf, "pages"), "html", "page_id").select("page_id", "length")
