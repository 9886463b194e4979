"""Socket frames to pools and matches, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A frame is digits followed by an array whose second element is the content.
FRAME = r"(?s)^\s*\d+(\[.*)$"
EMPTY_CONTENT = ["null", "{}", "[]", '""', "0", "false"]


def decode(body) -> Column:
    """Content object of a frame as variant; null for anything else (heartbeats, acknowledgements)."""
    text = F.col(body) if isinstance(body, str) else body
    array = F.try_parse_json(F.nullif(F.regexp_extract(F.trim(text), FRAME, 1), F.lit("")))
    content = F.try_variant_get(array, "$[1]", "variant")
    return F.when(F.startswith(F.schema_of_variant(content), F.lit("OBJECT")), content)


def entries(frames: DataFrame, body: str = "body", *keep: str) -> DataFrame:
    """One row per pool or match entry of a frame: ``kind, id, payload``; empty entries are ignored."""
    content = frames.select(*keep, decode(body).alias("c")).where("c IS NOT NULL")
    part = lambda kind, path: F.transform(
        F.coalesce(F.map_entries(F.from_json(F.to_json(F.try_variant_get("c", path, "variant")), "map<string,variant>")),
                   F.array().cast("array<struct<key:string,value:variant>>")),
        lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].cast("long").alias("id"), F.to_json(e["value"]).alias("payload")))
    rows = content.select(*keep, F.explode(F.concat(part("pool", "$.pools"), part("match", "$.matches"))).alias("e"))
    return rows.select(*keep, "e.*").where(~F.col("payload").isin(EMPTY_CONTENT))


def accumulate(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Last entry per pool and match; the same aggregate runs on a batch and on a stream."""
    return rows.groupBy("kind", "id").agg(F.max_by("payload", seq).alias("payload"), F.max(seq).alias(seq))


POOL_CONTENT = ("poolId bigint, poolStatus string, poolTitle string, poolEnd bigint, prizepoolAmount double, "
                "guaranteedAmount double, netStakes double, addedAmount double, matches array<bigint>, strPoolResult string, "
                "payout array<struct<nbCorrectResults:int,winningGrids:bigint,winningsPerGrid:double>>, repart array<bigint>")
MATCH_CONTENT = ("matchId bigint, status string, matchStart bigint, competitor1Id string, competitor1Name string, "
                 "competitor2Id string, competitor2Name string, regularScore1 int, regularScore2 int, odds1 double, "
                 "oddsX double, odds2 double")


def pool_rows(accumulated: DataFrame) -> DataFrame:
    from poolspark.functions.dates import epoch_timestamp

    p = accumulated.where("kind = 'pool'").select("id", F.from_json("payload", POOL_CONTENT).alias("p"))
    payouts = F.transform("p.payout", lambda r: F.struct(
        r["nbCorrectResults"].alias("rank"), r["winningGrids"].alias("winners"), r["winningsPerGrid"].alias("amount")))
    return p.select(
        F.col("id").alias("global_id"), (F.col("id") % 1_000_000).alias("pool_id"), F.expr("int(id div 1000000)").alias("pool_type"),
        F.col("p.poolTitle").alias("title"), F.col("p.poolStatus").alias("status"), epoch_timestamp("p.poolEnd").alias("closed_at"),
        F.col("p.netStakes").alias("net_stakes"), F.col("p.prizepoolAmount").alias("distributed"),
        F.col("p.guaranteedAmount").alias("guaranteed"), F.col("p.addedAmount").alias("added"),
        F.col("p.strPoolResult").alias("result_code"), payouts.alias("payouts"), F.col("p.repart").alias("histogram"),
        F.coalesce("p.matches", F.array().cast("array<bigint>")).alias("match_ids"))


def match_fields(m: str | Column) -> list[Column]:
    """Columns of a match from its parsed content."""
    from poolspark.functions.dates import epoch_timestamp

    m = F.col(m) if isinstance(m, str) else m
    return [epoch_timestamp(m["matchStart"]).alias("kickoff"), m["competitor1Name"].alias("home"), m["competitor2Name"].alias("away"),
            m["competitor1Id"].alias("home_id"), m["competitor2Id"].alias("away_id"), m["regularScore1"].alias("score_home"),
            m["regularScore2"].alias("score_away"), m["status"].alias("status"), m["odds1"].alias("p1"), m["oddsX"].alias("px"), m["odds2"].alias("p2")]


def match_rows(accumulated: DataFrame) -> DataFrame:
    m = accumulated.where("kind = 'match'").select("id", F.from_json("payload", MATCH_CONTENT).alias("m"))
    return m.select(F.col("id").alias("match_id"), *match_fields("m"))


def composed(records: DataFrame) -> DataFrame:
    """Complete pools from ``id, payload, lines`` (the payloads of all matches, in the pool's order)."""
    pools = pool_rows(records.select("id", "payload", F.lit("pool").alias("kind"))).drop("match_ids")
    parsed = records.select(F.col("id").alias("global_id"), F.transform("lines", lambda l: F.struct(  # noqa: E741
        l["match_id"].alias("match_id"), F.from_json(l["payload"], MATCH_CONTENT).alias("m"))).alias("lines"))
    matches = F.transform("lines", lambda l, i: F.struct(  # noqa: E741
        i.alias("ord"), l["match_id"].alias("match_id"), *match_fields(l["m"]), F.lit(False).alias("missing_in_frame")))
    return pools.join(parsed.select("global_id", matches.alias("matches")), "global_id")


def completeness(accumulated: DataFrame) -> DataFrame:
    """Per pool: matches expected, received, and whether it may be stored. A pool without matches never is."""
    pools = pool_rows(accumulated).select("global_id", "match_ids")
    seen = accumulated.where("kind = 'match'").select(F.col("id").alias("match_id"), F.lit(1).alias("seen"))
    rows = pools.select("global_id", F.explode_outer("match_ids").alias("match_id")).join(seen, "match_id", "left")
    expected, received = F.count("match_id"), F.count("seen")
    return rows.groupBy("global_id").agg(expected.alias("expected"), received.alias("received")).withColumn(
        "complete", (F.col("expected") > 0) & (F.col("expected") == F.col("received")))


def complete_pools(accumulated: DataFrame) -> DataFrame:
    """Complete pools with their matches in the pool's order."""
    from poolspark.operators.matching import compose_pool

    ready = completeness(accumulated).where("complete").select("global_id")
    pools = pool_rows(accumulated).join(ready, "global_id", "left_semi")
    lines = compose_pool(pools, match_rows(accumulated), ["global_id"])
    return pools.drop("match_ids").join(lines, "global_id")
