"""Pools, fixtures and snapshots derived from the star-schema tables.

Plain projections with integer arithmetic on keys, so every operator can be run on tables of any
size and checked against an independent SQL engine. A pool gathers four consecutive orders; its
matches are the distinct line numbers (1 to 7), each the aggregate of the lines sharing it, so a
pool never holds more than seven matches however many lines one order has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPETITIONS = ["E0", "SP1", "D1", "I1", "F1", "E1", "N1", "Champions League", "World Cup 2022",
                "Copa Libertadores", "BRA · Serie A", None]
SOURCES = ["pinnacle_cloture", "winamax", "bet365", "pinnacle", "autre"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(value: Column) -> Column:
    return value.cast("double") / F.lit(100.0)


def _listed(values, index: str) -> str:
    quoted = ", ".join("null" if v is None else f"'{v}'" for v in values)
    return f"array({quoted})[cast({index} as int)]"


def _price(name: str, formula: str, settled: str) -> str:
    return f"if(mix % 53 = 0, null, if(mix % 41 = 0, {settled}, cast({formula} as double) / 100D)) as {name}"


def legs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per match of a pool."""
    return legs_of(table(spark, sf, "lineitem"))


def legs_of(lineitem: DataFrame) -> DataFrame:
    base = (lineitem
            .selectExpr("l_orderkey div 4 as pool_id", "l_linenumber as line", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
            .groupBy("pool_id", "line").agg(F.expr("min(l_partkey) as part"), F.expr("max(l_suppkey) as supp"),
                                            F.expr("sum(cast(l_quantity as bigint)) as qty"),
                                            F.expr("min(cast(l_shipdate as date)) as kickoff")))
    mixed = base.selectExpr("*", "part * 7 + supp * 3 + qty as mix", "(part + supp + qty) % 3 as sign")
    margin = "cast(1 + supp % 2 as int)"
    return mixed.selectExpr(
        "pool_id", "line", "part * 31 + supp % 31 as match_id", "part", "supp", "mix", "kickoff",
        "concat('Équipe ', part % 211) as home", "concat('Club ', supp % 97) as away",
        _price("p1", "105 + (qty * 37 + part) % 420", "1D"), _price("px", "260 + (part * 7 + supp) % 240", "250D"),
        _price("p2", "115 + (part * 13 + supp * 5) % 1300", "250D"),
        """case when mix % 47 = 0 then '111' when mix % 211 = 0 then '000' when mix % 223 = 0 then '110'
           when sign = 0 then '100' when sign = 1 then '010' else '001' end as code""",
        f"if(mix % 47 = 0, null, cast(part % 3 as int) + if(sign = 0, {margin}, 0)) as score_home",
        f"if(mix % 47 = 0, null, cast(part % 3 as int) + if(sign = 2, {margin}, 0)) as score_away",
        _listed(COMPETITIONS, "part % 12") + " as competition", _listed(SOURCES, "supp % 5") + " as source")


# SQL text of the same view for the second engine; ``ord`` is the position inside the pool.
LEGS_SQL = """
lines AS (
  SELECT l_orderkey // 4 AS pool_id, l_linenumber AS line, min(l_partkey) AS part, max(l_suppkey) AS supp,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, min(CAST(l_shipdate AS DATE)) AS kickoff
  FROM lineitem GROUP BY 1, 2),
mixed AS (SELECT *, part*7 + supp*3 + qty AS mix, (part + supp + qty) % 3 AS sign FROM lines),
legs AS (
  SELECT pool_id, line, CAST(row_number() OVER (PARTITION BY pool_id ORDER BY line) - 1 AS INT) AS ord,
    CAST(count(*) OVER (PARTITION BY pool_id) AS INT) AS n_legs,
    part*31 + supp % 31 AS match_id, part, supp, mix, kickoff,
    'Équipe ' || (part % 211) AS home, 'Club ' || (supp % 97) AS away,
    CASE WHEN mix % 53 = 0 THEN NULL WHEN mix % 41 = 0 THEN 1.0::DOUBLE
         ELSE (105 + (qty*37 + part) % 420)::DOUBLE / 100.0::DOUBLE END AS p1,
    CASE WHEN mix % 53 = 0 THEN NULL WHEN mix % 41 = 0 THEN 250.0::DOUBLE
         ELSE (260 + (part*7 + supp) % 240)::DOUBLE / 100.0::DOUBLE END AS px,
    CASE WHEN mix % 53 = 0 THEN NULL WHEN mix % 41 = 0 THEN 250.0::DOUBLE
         ELSE (115 + (part*13 + supp*5) % 1300)::DOUBLE / 100.0::DOUBLE END AS p2,
    CASE WHEN mix % 47 = 0 THEN '111' WHEN mix % 211 = 0 THEN '000' WHEN mix % 223 = 0 THEN '110'
         WHEN sign = 0 THEN '100' WHEN sign = 1 THEN '010' ELSE '001' END AS code,
    CASE WHEN mix % 47 <> 0 THEN CAST(part % 3 + CASE WHEN sign = 0 THEN 1 + supp % 2 ELSE 0 END AS INT) END
      AS score_home,
    CASE WHEN mix % 47 <> 0 THEN CAST(part % 3 + CASE WHEN sign = 2 THEN 1 + supp % 2 ELSE 0 END AS INT) END
      AS score_away,
    CASE part % 12 WHEN 0 THEN 'E0' WHEN 1 THEN 'SP1' WHEN 2 THEN 'D1' WHEN 3 THEN 'I1' WHEN 4 THEN 'F1'
      WHEN 5 THEN 'E1' WHEN 6 THEN 'N1' WHEN 7 THEN 'Champions League' WHEN 8 THEN 'World Cup 2022'
      WHEN 9 THEN 'Copa Libertadores' WHEN 10 THEN 'BRA · Serie A' END AS competition,
    CASE supp % 5 WHEN 0 THEN 'pinnacle_cloture' WHEN 1 THEN 'winamax' WHEN 2 THEN 'bet365'
      WHEN 3 THEN 'pinnacle' ELSE 'autre' END AS source
  FROM mixed)"""


def _payout(rank: str) -> str:
    return f"""named_struct('rank', cast({rank} as int), 'winners', (pool_id * 31 + ({rank}) * 17) % 50, 'amount',
      if((pool_id + {rank}) % 13 = 0, null, cast((pool_id * 7919 + ({rank}) * 104729) % 90000 + 100 as double) / 100D))"""


# Columns of a match inside its pool; ``line`` orders them and ``code`` gives the result code.
FIELDS = ("line", "match_id", "kickoff", "home", "away", "score_home", "score_away", "p1", "px", "p2", "code",
          "competition", "source", "part", "supp", "mix")


def pools(spark: SparkSession, sf: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Feed-form pools: matches, payouts, histogram and result code as nested columns."""
    return pools_of(legs(spark, sf), table(spark, sf, "orders"), fields)


def pools_of(matches: DataFrame, orders: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    nested = matches.groupBy("pool_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("matches"))
    orders = orders.groupBy(F.expr("o_orderkey div 4 as pool_id")).agg(
        F.expr("cast(sum(cast(o_totalprice as decimal(18,2))) as double) as net_stakes"),
        F.expr("max(cast(o_orderdate as date)) as closed_on"), F.expr("max(o_orderstatus) as status"))
    return nested.join(orders, "pool_id").selectExpr("*", "size(matches) as n").selectExpr(
        "pool_id", "case when pool_id % 10 < 7 then 7 when pool_id % 10 < 9 then 9 else 12 end as pool_type",
        "status", "closed_on", "net_stakes",
        "if(pool_id % 37 = 0, null, cast(pool_id * 4861 % 900000 as double) / 100D) as distributed",
        "cast(pool_id * 353 % 100000 as double) / 100D as guaranteed",
        "if(pool_id % 29 = 0, null, array_join(reverse(transform(matches, m -> m.code)), '')) as result_code",
        f"if(pool_id % 31 = 0, array({_payout('n')}), array({_payout('n')}, {_payout('n - 1')})) as payouts",
        "if(pool_id % 11 = 0, null, transform(sequence(0, n), k -> (pool_id + k * 31) % 97 + 1)) as histogram",
        "n", "matches")


POOLS_SQL = LEGS_SQL + """,
pool_orders AS (
  SELECT o_orderkey // 4 AS pool_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS net_stakes,
         max(CAST(o_orderdate AS DATE)) AS closed_on, max(o_orderstatus) AS status
  FROM orders GROUP BY 1),
pools AS (
  SELECT l.pool_id, CASE WHEN l.pool_id % 10 < 7 THEN 7 WHEN l.pool_id % 10 < 9 THEN 9 ELSE 12 END AS pool_type,
    status, closed_on, net_stakes,
    CASE WHEN l.pool_id % 37 <> 0 THEN (l.pool_id*4861 % 900000)::DOUBLE / 100.0::DOUBLE END AS distributed,
    (l.pool_id*353 % 100000)::DOUBLE / 100.0::DOUBLE AS guaranteed,
    l.pool_id % 29 <> 0 AS has_code, l.pool_id % 11 <> 0 AS has_histogram, n
  FROM (SELECT pool_id, CAST(count(*) AS INT) AS n FROM legs GROUP BY 1) l JOIN pool_orders o USING (pool_id)),
payouts AS (
  SELECT pool_id, k AS rank, (pool_id*31 + k*17) % 50 AS winners,
    CASE WHEN (pool_id + k) % 13 <> 0 THEN ((pool_id*7919 + k*104729) % 90000 + 100)::DOUBLE / 100.0::DOUBLE END
      AS amount
  FROM (SELECT pool_id, n AS k FROM pools UNION ALL SELECT pool_id, n - 1 FROM pools WHERE pool_id % 31 <> 0) t),
crowd AS (
  SELECT pool_id, k, (pool_id + 31*k) % 97 + 1 AS slips
  FROM pools, range(0, 8) r(k) WHERE has_histogram AND k <= n),
outcomes AS (
  SELECT l.*, p.pool_type, p.has_code,
    CASE WHEN NOT p.has_code THEN NULL WHEN code = '000' THEN NULL WHEN code = '111' THEN 3
         WHEN code = '110' THEN 2 ELSE 1 END AS n_out,
    CASE WHEN p.has_code AND code IN ('100','010','001') THEN strpos(code, '1') - 1 END AS winner,
    p1 IS NOT NULL AND least(p1, px, p2) >= 1.06 AND greatest(p1, px, p2) <= 100 AS plausible
  FROM legs l JOIN pools p USING (pool_id))"""


def match_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Published price per match id: the plausible trio of its first occurrence."""
    from poolspark.functions.prices import plausible_market

    rows = legs(spark, sf).where(plausible_market("p1", "px", "p2"))
    first = F.min_by(F.struct("p1", "px", "p2", "source", "competition"), F.struct("pool_id", "line"))
    return rows.groupBy("match_id").agg(first.alias("f")).select("match_id", "f.*")


def ext_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    """External fixtures: the matches, some missing, shifted, repeated, rescored or unpriced."""
    l = legs(spark, sf)
    mid = F.col("match_id")
    shift = F.when(mid % 7 == 1, 1).when(mid % 7 == 2, -1).when(mid % 7 == 3, 2).otherwise(0)
    copies = F.when(mid % 17 == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    trio = F.struct((F.col("part") % 300 / 100.0 + 1.1).alias("p1"), F.lit(3.4).alias("px"), F.lit(4.2).alias("p2"))
    prices = F.map_from_entries(F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(name), trio)) for name, cond in (
            ("pinnacle_cloture", mid % 3 == 0), ("pinnacle", mid % 5 == 0),
            ("bet365_cloture", mid % 4 == 1), ("bet365", mid % 6 == 2))])))
    return (l.where(mid % 13 != 0).select("*", F.explode(copies).alias("copy")).select(
        F.col("home").alias("home_name"), F.col("away").alias("away_name"),
        F.lower(F.regexp_replace("home", "[ É]", "")).alias("home_key_raw"),
        F.date_add("kickoff", shift).alias("match_date"),
        F.when(mid % 23 != 0, F.col("score_home") + F.when(mid % 19 == 0, 1).otherwise(0)).alias("goals_home"),
        F.when(mid % 23 != 0, F.col("score_away")).alias("goals_away"),
        prices.alias("prices"), "competition").drop("home_key_raw"))


EXT_SQL = """
ext AS (
  SELECT home AS home_name, away AS away_name,
    CAST(kickoff + CAST(CASE match_id % 7 WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 3 THEN 2 ELSE 0 END AS INT) AS DATE)
      AS match_date,
    CASE WHEN match_id % 23 <> 0 THEN score_home + CASE WHEN match_id % 19 = 0 THEN 1 ELSE 0 END END AS goals_home,
    CASE WHEN match_id % 23 <> 0 THEN score_away END AS goals_away,
    part % 300 / 100.0::DOUBLE + 1.1::DOUBLE AS e1, 3.4::DOUBLE AS ex, 4.2::DOUBLE AS e2,
    match_id % 3 = 0 AS has_pc, match_id % 5 = 0 AS has_p, match_id % 4 = 1 AS has_bc, match_id % 6 = 2 AS has_b,
    competition
  FROM legs, range(0, 2) c(copy) WHERE match_id % 13 <> 0 AND (copy = 0 OR match_id % 17 = 0))"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Successive price observations of a match, one per event."""
    return snapshots_of(table(spark, sf, "events"))


def snapshots_of(e: DataFrame) -> DataFrame:
    eid, cent = F.col("event_id"), F.round(F.col("value") * 100).cast("long")
    settled, absent = eid % 4 == 1, eid % 5 == 2
    value = lambda v, s: F.when(~absent, F.when(settled, F.lit(s)).otherwise(v))
    return e.select(
        F.col("user_id").alias("match_id"), (F.col("user_id") % 20).alias("pool_id"),
        F.col("ts").cast("timestamp").alias("collected_at"), F.col("event_id").alias("seq"),
        value(cents(110 + cent % 400), 1.0).alias("p1"),
        value(cents(250 + cent % 300), 250.0).alias("px"),
        value(cents(120 + cent % 900), 250.0).alias("p2"))


SNAPSHOTS_SQL = """
snaps AS (
  SELECT user_id AS match_id, user_id % 20 AS pool_id, ts AS collected_at, event_id AS seq,
    CASE WHEN event_id % 5 = 2 THEN NULL WHEN event_id % 4 = 1 THEN 1.0::DOUBLE
         ELSE (110 + CAST(round(value*100) AS BIGINT) % 400)::DOUBLE / 100.0::DOUBLE END AS p1,
    CASE WHEN event_id % 5 = 2 THEN NULL WHEN event_id % 4 = 1 THEN 250.0::DOUBLE
         ELSE (250 + CAST(round(value*100) AS BIGINT) % 300)::DOUBLE / 100.0::DOUBLE END AS px,
    CASE WHEN event_id % 5 = 2 THEN NULL WHEN event_id % 4 = 1 THEN 250.0::DOUBLE
         ELSE (120 + CAST(round(value*100) AS BIGINT) % 900)::DOUBLE / 100.0::DOUBLE END AS p2
  FROM events),
judged AS (
  SELECT *, p1 IS NOT NULL AND least(p1, px, p2) >= 1.06 AND greatest(p1, px, p2) <= 100 AS ok FROM snaps)"""
