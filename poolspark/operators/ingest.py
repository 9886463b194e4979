"""Operators over the ingestion log and the archive chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolspark.scale import LEVELS, WIDTH, neighbours, running_total

# Consecutive events that stop a collection.
STOP_ERRORS = 5
STOP_ABSENT = 40
STOP_EMPTY = 15
STOP_IDENTICAL = 3


def run_positions(log: DataFrame, group: Sequence[str], key: str, counts: Column, resets: Column, *,
                  width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """Adds ``position``: how many counted events the current run holds, up to and including the row.

    ``resets`` starts a new run before the row is counted. Two bucketed passes (running count, count
    at the last reset), so a run may span any number of rows and tasks.
    """
    marked = log.withColumn("__c", counts.cast("long")).withColumn("__r", resets)
    total = running_total(marked, group, key, "__c", "__before", width=width, levels=levels)
    near = neighbours(total, group, key, {"base": F.when(F.col("__r"), F.col("__before"))}, width=width, levels=levels)
    base = F.when(F.col("__r"), F.col("__before")).otherwise(F.coalesce("prev_base", F.lit(0)))
    return (near.withColumn("position", F.col("__before") + F.col("__c") - base)
            .drop("__c", "__r", "__before", "prev_base", "next_base"))


def consecutive(log: DataFrame, group: Sequence[str], key: str, status: str, kind: str, transparent: Sequence[str] = ("present",),
                **sizes) -> DataFrame:
    """Run positions of one kind of event; transparent statuses neither count nor reset."""
    rows = log.where(~F.col(status).isin(list(transparent)))
    is_kind = F.col(status) == kind
    return run_positions(rows, group, key, is_kind, ~is_kind, **sizes)


def repeated_payloads(log: DataFrame, group: Sequence[str], key: str, signature: str, **sizes) -> DataFrame:
    """Run positions of equal signatures among saved payloads; an empty payload (null) restarts at one."""
    near = neighbours(log, group, key, {"sig": F.coalesce(F.col(signature), F.lit(""))}, **sizes)
    same = F.coalesce(F.col(signature) == F.col("prev_sig"), F.lit(False))
    return run_positions(near.drop("next_sig").withColumn("__same", same).drop("prev_sig"), group, key,
                         F.lit(1), ~F.col("__same"), **sizes).drop("__same")


def first_breach(positions: DataFrame, group: Sequence[str], key: str, limit: int, label: str) -> DataFrame:
    """Where a collection would have stopped: ``stop_at`` and the rule."""
    return (positions.where(F.col("position") >= limit).groupBy(*group).agg(F.min(key).alias("stop_at"))
            .select(*group, F.lit(label).alias("rule"), "stop_at"))


def resume_range(log: DataFrame, breaches: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Earliest stop per group and the range left to collect from there."""
    stops = breaches.groupBy(*group).agg(F.min_by("rule", F.struct("stop_at", "rule")).alias("rule"), F.min("stop_at").alias("resume_from"))
    last = log.groupBy(*group).agg(F.max(key).alias("resume_to"))
    return stops.join(last, list(group))


def recent_ids(active: DataFrame, group: Sequence[str], key: str, n: int) -> DataFrame:
    """The ``n`` numbers down from the highest active one."""
    top = active.groupBy(*group).agg(F.max(key).alias("top"))
    return top.select(*group, F.explode(F.sequence(F.greatest(F.col("top") - n + 1, F.lit(1)), F.col("top"))).alias(key))


def resume_point(stored: DataFrame, group: Sequence[str], key: str, link: str) -> DataFrame:
    """Smallest stored key of a group and its stored link to the predecessor."""
    return stored.groupBy(*group).agg(F.min(key).alias(key), F.min_by(link, key).alias(link))


def predecessor(links: Column, number: Column) -> Column:
    """Previous pool of the archive chain from ``array<struct<url,number>>`` of one page.

    Largest smaller number, else the largest number of another season, else null.
    """
    best = lambda rows: F.array_max(F.transform(rows, lambda l: F.struct(
        l["number"].alias("number"), l["url"].alias("url"))))["url"]
    before = F.filter(links, lambda l: l["number"] < number)
    others = F.filter(links, lambda l: l["number"] != number)
    return F.when(F.size(before) > 0, best(before)).otherwise(best(others))


def page_predecessor(links: DataFrame, page: Sequence[str], url: str, number: str, wanted: str, out: str = "previous") -> DataFrame:
    """The rule of ``predecessor`` over one row per link, ``wanted`` being the number of its page; no page is held as a whole."""
    link = F.struct(F.col(number).alias("number"), F.col(url).alias("url"))
    before = F.max(F.when(F.col(number) < F.col(wanted), link))
    others = F.max(F.when(F.col(number) != F.col(wanted), link))
    return links.groupBy(*page).agg(F.coalesce(before, others)["url"].alias(out))


def chain_predecessors(archive: DataFrame, season: str, number: str, **sizes) -> DataFrame:
    """Stored predecessor of every archive pool: previous number of its season, else the last of the season before."""
    inside = neighbours(archive, [season], number, {"number": F.col(number)}, **sizes).drop("next_number")
    # One row per season: a handful, whatever the number of pools.
    lasts = archive.groupBy(season).agg(F.max(number).alias("last_number"))
    linked = neighbours(lasts.withColumn("__g", F.lit(0)), ["__g"], season, {
        "last": F.struct(F.col(season).alias("season"), F.col("last_number").alias("number"))}, levels=0)
    before = linked.select(season, F.col("prev_last").alias("before"))
    return inside.join(before, season, "left").select(
        *archive.columns,
        F.when(F.col("prev_number").isNotNull(), F.col(season)).otherwise(F.col("before.season")).alias("prev_season"),
        F.coalesce("prev_number", "before.number").alias("prev_number"))
