"""The crowd against two reference players, pool by pool and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolspark.functions import prices as P
from poolspark.functions import results as R
from poolspark.operators.market import fully_priced
from poolspark.scale import order_statistics
from poolspark.session import cut_lineage

# Least pools per year, per pool type, and the random player's share.
MIN_YEAR_POOLS = 20
MIN_TYPE_POOLS = 30


def with_signs(pools: DataFrame) -> DataFrame:
    """Adds ``signs`` (winning outcomes) and ``winners`` (the only one, else null) per match."""
    return (pools.withColumn("signs", R.decode_result("result_code", F.size("matches")))
            .withColumn("winners", F.transform("signs", R.single_outcome)))


def settled_singly(winners: Column) -> Column:
    """Every match has exactly one winning outcome."""
    return F.coalesce(F.forall(winners, lambda w: w.isNotNull()), F.lit(False)) & (F.size(winners) > 0)


def judgeable(pools: DataFrame) -> DataFrame:
    """Pools with a usable histogram, every match priced and settled on one outcome."""
    h = F.col("histogram")
    usable = h.isNotNull() & (F.size(h) == F.size("matches") + 1) & (R.slips_played(h) > 0)
    return with_signs(pools.where(usable & fully_priced(F.col("matches")))).where(settled_singly(F.col("winners")))


def evaluate(pools: DataFrame, *keep: str) -> DataFrame:
    """One row per judgeable pool: crowd, favourite follower and proportional player, and the columns ``keep`` of the pool.

    Row-level arithmetic on the nested matches; nothing is exploded or shuffled.
    """
    judged = F.zip_with("matches", "winners", lambda m, w: F.struct(
        (P.favourite(F.array(m["p1"], m["px"], m["p2"])) == w).cast("int").alias("hit"),
        P.implied_probs(m["p1"], m["px"], m["p2"])[w].alias("p")))
    n = F.size("matches")
    amounts, _ = R.payout_maps(F.coalesce("payouts", F.array().cast("array<struct<rank:int,winners:bigint,amount:double>>")))
    return (judgeable(pools).withColumn("judged", judged)
            .withColumn("favourite_hits", F.aggregate("judged", F.lit(0), lambda a, m: a + m["hit"]))
            .select("pool_id", "pool_type", *keep, F.year("closed_on").alias("year"), n.alias("n"),
                    R.slips_played("histogram").alias("slips"),
                    R.histogram_mean("histogram", n).alias("crowd"),
                    (F.col("favourite_hits") / n).alias("favourite"),
                    (F.aggregate("judged", F.lit(0.0), lambda a, m: a + m["p"]) / n).alias("proportional"),
                    "favourite_hits",
                    R.at_rank(amounts, F.col("favourite_hits")).alias("favourite_gain")))


def _means() -> list[Column]:
    return [F.count("*").alias("pools"), F.avg("crowd").alias("crowd"), F.avg("favourite").alias("favourite"),
            F.avg("proportional").alias("proportional")]


def overall(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(*_means(), F.avg("n").alias("mean_size"), F.sum("slips").alias("slips")).select(
        "*", ((F.col("favourite") - F.col("crowd")) * 100).alias("points_to_favourite"),
        ((F.col("proportional") - F.col("crowd")) * 100).alias("points_to_proportional"))


def by_year(evaluated: DataFrame, min_pools: int = MIN_YEAR_POOLS) -> DataFrame:
    return (evaluated.groupBy("year").agg(F.count("*").alias("pools"), F.avg("crowd").alias("crowd"),
                                          F.avg("favourite").alias("favourite"))
            .where(F.col("pools") >= min_pools)
            .withColumn("gap", (F.col("crowd") - F.col("favourite")) * 100))


def by_type(evaluated: DataFrame, min_pools: int = MIN_TYPE_POOLS) -> DataFrame:
    """Favourite slip per pool type and overall (null type)."""
    return (evaluated.rollup("pool_type").agg(
        F.count("*").alias("pools"), F.avg("favourite_gain").alias("mean_return"),
        F.avg((F.col("favourite_gain") > 0).cast("double")).alias("paid_share"))
        .where(F.col("pools") >= min_pools))


def histogram_checks(pools: DataFrame, unit_price: float = 1.0, share: float = 0.75) -> DataFrame:
    """Per pool: paid ranks whose winners differ from the histogram, and stakes against slips."""
    h, slips = F.col("histogram"), F.col("slips")
    _, winners = R.payout_maps("payouts")
    expected = slips * unit_price * share
    gap = F.abs(expected - F.col("net_stakes"))
    return (pools.where("histogram IS NOT NULL AND payouts IS NOT NULL")
            .withColumn("slips", R.slips_played(h)).withColumn("ranks", winners)
            .select("pool_id",
                    F.size(F.map_keys("ranks")).alias("ranks_checked"),
                    F.size(F.filter(F.map_entries("ranks"), lambda e: ~F.coalesce(
                        F.try_element_at(h, e["key"] + 1) == e["value"], F.lit(False)))).alias("ranks_different"),
                    F.when(F.coalesce("net_stakes", F.lit(0.0)) == 0, "zero")
                    .when(gap < 0.005, "exact").when(gap < F.col("net_stakes") * 0.01, "under 1 %")
                    .otherwise("beyond").alias("stakes_class")))


def carry_over(pools: DataFrame, lower_ranks: int = 1, lower_share: float = 0.20) -> DataFrame:
    """Dotation inferred from the lower ranks' share and the amount carried over to the pool."""
    lower = F.aggregate(
        F.filter("payouts", lambda r: r["rank"] < F.size("matches") - lower_ranks + 1),
        F.lit(0.0), lambda a, r: a + F.coalesce(r["amount"] * r["winners"], F.lit(0.0)))
    dotation = lower / lower_share
    return pools.where("distributed IS NOT NULL").select(
        "pool_id", "pool_type", dotation.alias("dotation"), (F.col("distributed") - dotation).alias("carry"))


def carry_summary(carried: DataFrame) -> DataFrame:
    """Count, largest and median carry-over; the median is the exact lower middle element."""
    n = F.col("n")
    carried = cut_lineage(carried.select("carry"))
    stats = order_statistics(carried, "carry", {"median_carry": (0.5, F.floor((n - 1) / 2))}, materialise=False)
    return stats.withColumn("max_carry", carried.agg(F.max("carry")).scalar())


def pool_facts(pools: DataFrame) -> DataFrame:
    """Share given back, home-win rate and rank split of the pot, per pool type."""
    rows = with_signs(pools)
    home = F.size(F.filter("winners", lambda w: w == 0))
    known = F.size(F.filter("winners", lambda w: w.isNotNull()))
    paid = lambda r: F.aggregate(
        F.filter("payouts", lambda p: p["rank"] == r), F.lit(0.0),
        lambda a, p: a + F.coalesce(p["amount"] * p["winners"], F.lit(0.0)))
    return (rows.select("pool_type", "net_stakes", "distributed", home.alias("home"), known.alias("known"),
                        paid(F.size("matches")).alias("top"),
                        F.aggregate("payouts", F.lit(0.0), lambda a, p: a + F.coalesce(
                            p["amount"] * p["winners"], F.lit(0.0))).alias("all_ranks"))
            .groupBy("pool_type").agg(
                F.count("*").alias("pools"),
                (F.sum(F.when(F.col("distributed").isNotNull(), F.col("distributed").cast("decimal(18,2)"))).cast("double")
                 / F.sum(F.when(F.col("distributed").isNotNull(), F.col("net_stakes").cast("decimal(18,2)"))).cast("double"))
                .alias("given_back"),
                (F.sum("home") / F.sum("known")).alias("home_rate"),
                (F.sum("top") / F.sum("all_ranks")).alias("top_rank_share")))
