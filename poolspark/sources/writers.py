"""Sinks. Tables are written by the executors; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolspark.functions.prices import plausible_market
from poolspark.operators.matching import keep_last_plausible
from poolspark.operators.slips import to_text
from poolspark.schemas import SNAPSHOT
from poolspark.sources.versions import Versions, last_observations


def write_prices(prices: DataFrame, path: str) -> None:
    """Prices keyed by match id, range-partitioned so files hold ordered slices."""
    prices.where("source IS NOT NULL").repartitionByRange("match_id").sortWithinPartitions("match_id").write.mode("overwrite").parquet(path)


def write_dates(dates: DataFrame, path: str) -> None:
    """Replace the pool types present in ``dates`` and keep the others."""
    (dates.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pool_type").parquet(path))


def write_aliases(aliases: DataFrame, path: str, source: str) -> None:
    """One alias table per external source; sources are never mixed."""
    (aliases.withColumn("source", F.lit(source)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("source").parquet(path))


def write_categories(categories: DataFrame, path: str) -> None:
    categories.write.mode("overwrite").partitionBy("pool_type").parquet(path)


def price_table(spark: SparkSession, path: str) -> Versions:
    """Snapshots of prices: history is appended, never rewritten, so an absence cannot destroy an observation.

    The view keeps the latest and the latest plausible observation of a match; ``latest_prices`` is what is published.
    """
    key = ["pool_type", "pool_id", "match_id"]
    return Versions(spark, path, SNAPSHOT, key, last_observations(key, "collected_at", plausible_market("p1", "px", "p2")))


def latest_prices(table: Versions) -> DataFrame:
    """Current view of the snapshot table, pre-match prices retained."""
    return keep_last_plausible(table.rows(), ["pool_type", "pool_id", "match_id"], ["collected_at"])


def write_index(index: DataFrame, path: str) -> None:
    """Published index as JSON lines, one directory per pool type."""
    index.write.mode("overwrite").partitionBy("type").json(path)


def write_compact_prices(prices: DataFrame, path: str) -> None:
    prices.write.mode("overwrite").parquet(path)


def write_report(rows: DataFrame, path: str, lines: int = 40, *order: str) -> DataFrame:
    """Untruncated report on disk, the first ``lines`` rows as a frame for the screen."""
    rows.write.mode("overwrite").json(path)
    return rows.orderBy(*order).limit(lines)


def write_slips(slips: DataFrame, path: str, picks: str = "picks") -> None:
    """Slips as text lines such as ``1N2``."""
    slips.select(to_text(picks).alias("value")).write.mode("overwrite").text(path)


def write_compacted(pools: DataFrame, path: str) -> None:
    """Pool documents as parquet partitioned by type, the form every later scan reads."""
    pools.write.mode("overwrite").partitionBy("pool_type").parquet(path)
