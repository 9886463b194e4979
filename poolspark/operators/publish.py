"""The published index: one flat row per pool, compact prices, upcoming pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolspark.functions import prices as P
from poolspark.functions import results as R
from poolspark.functions import text as T

# Price ratio of a big surprise; column names of the published index.
BIG_SURPRISE = 3.0
INDEX_FIELDS = ["type", "id", "date", "famille", "matchs", "cotees", "mises", "garanti", "distribue", "jouees", "trj",
                "rapports", "affiches", "debut", "statut", "surprises", "grosses"]


def surprises(matches: str, signs: str) -> tuple[Column, Column]:
    """Matches won by something else than the favourite, and by at least three times its price.

    One unknown outcome, or no priced match at all, gives nulls: an absence is not a zero. Cancelled
    and unpriced matches are left out of both counts.
    """
    rows = f"filter(arrays_zip({matches}, {signs}), z -> size(z.{signs}) = 1 and z.{matches}.p1 is not null)"
    trio = f"array(z.{matches}.p1, z.{matches}.px, z.{matches}.p2)"
    won = f"{trio}[array_position(array('1', 'N', '2'), z.{signs}[0]) - 1]"
    valid = F.expr(f"not exists({signs}, s -> s is null) and size({rows}) > 0")
    small = F.expr(f"size(filter({rows}, z -> {won} > array_min({trio})))")
    big = F.expr(f"size(filter({rows}, z -> {won} > array_min({trio}) and {won} >= {BIG_SURPRISE}D * array_min({trio})))")
    return F.when(valid, small), F.when(valid, big)


def with_published_prices(pools: DataFrame, prices: DataFrame, key: str = "pool_id") -> DataFrame:
    """Replace the matches' own prices by the published ones (null when unpublished), in match order."""
    rows = pools.select(key, F.posexplode("matches").alias("ord", "m")).select(
        key, "ord", "m.match_id", "m.home", "m.away", "m.kickoff")
    published = prices.select("match_id", "p1", "px", "p2")
    priced = rows.join(published, "match_id", "left").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        "ord", "match_id", "home", "away", "kickoff", "p1", "px", "p2"))).alias("matches"))
    return pools.drop("matches").join(priced, key, "left").withColumn(
        "matches", F.coalesce("matches", F.expr("slice(matches, 1, 0)")))


def published_index(pools: DataFrame, prices: DataFrame, categories: DataFrame) -> DataFrame:
    """The 17 index columns; ``categories`` gives ``pool_id, family`` (missing gives the empty string)."""
    known = categories.select("pool_id", F.col("family").alias("__family"))
    rows = with_published_prices(pools, prices).join(known, "pool_id", "left").withColumn(
        "signs", R.decode_result("result_code", F.size("matches")))
    small, big = surprises("matches", "signs")
    played = F.when(F.size("histogram") > 0, R.slips_played("histogram"))
    return rows.select(
        F.col("pool_type").alias("type"), F.col("pool_id").alias("id"), F.col("closed_on").alias("date"),
        F.coalesce("__family", F.lit("")).alias("famille"), F.size("matches").alias("matchs"),
        F.expr("size(filter(matches, m -> m.p1 is not null))").alias("cotees"), F.col("net_stakes").alias("mises"),
        F.col("guaranteed").alias("garanti"), F.col("distributed").alias("distribue"), played.alias("jouees"),
        P.payout_ratio(F.col("distributed"), played).alias("trj"),
        F.coalesce("payouts", F.expr("slice(payouts, 1, 0)")).alias("rapports"),
        T.fixture_list("matches").alias("affiches"),
        F.expr("array_min(transform(matches, m -> m.kickoff))").alias("debut"), F.col("status").alias("statut"),
        small.alias("surprises"), big.alias("grosses"))


def compact_prices(prices: DataFrame) -> DataFrame:
    """Trio and one source letter per match; prices of other sources are left out."""
    return prices.withColumn("letter", P.source_letter("source")).where("letter IS NOT NULL").select(
        "match_id", "p1", "px", "p2", "letter")


def upcoming(index: DataFrame, now: Column) -> DataFrame:
    """Pools whose first kickoff lies after ``now``, soonest first."""
    return index.where(F.col("debut") > now).orderBy("debut", "type", "id")
