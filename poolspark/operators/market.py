"""Flat-stake returns, calibration and combined bets over priced matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolspark.functions import prices as P
from poolspark.functions import results as R
from poolspark.scale import order_statistics

# Half-open price bands, the last one open, and the least bets a band must hold.
BANDS = [(1.0, 1.3), (1.3, 1.6), (1.6, 2.0), (2.0, 2.5), (2.5, 3.2), (3.2, 4.5), (4.5, 7.0), (7.0, 12.0),
         (12.0, float("inf"))]
MIN_BETS = 100
# Limits of the favourite and longshot sides, least matches per source and per family.
FAVOURITE_BELOW = 2.5
LONGSHOT_FROM = 4.5
MIN_SOURCE_MATCHES = 500
MIN_FAMILY_MATCHES = 400
# Share of the stakes a pool gives back, least pools for the combo comparison.
POOL_RETURN = 0.75
MIN_COMBO_POOLS = 30


def explode_matches(pools: DataFrame, *keep: str) -> DataFrame:
    """One row per match with its position and the set of winning outcomes."""
    signs = R.decode_result("result_code", F.size("matches"))
    return (pools.select(*keep, F.posexplode(F.arrays_zip(F.col("matches").alias("m"), signs.alias("signs")))
                         .alias("ord", "z"))
            .select(*keep, "ord", "z.signs", "z.m.*"))


def qualified_matches(matches: DataFrame, order: Sequence[str], *, by: str = "match_id",
                      where: Column | None = None) -> DataFrame:
    """First qualifying occurrence of a match: priced, one winning outcome, optional extra filter.

    ``order`` gives the reading order. The pick is an aggregate, so a match repeated in a third of
    the pools is reduced before the shuffle.
    """
    rows = matches.withColumn("winner", R.single_outcome(F.col("signs"))).where(
        F.col("winner").isNotNull() & F.col("p1").isNotNull())
    if where is not None:
        rows = rows.where(where)
    rest = [c for c in rows.columns if c not in (by, "signs")]
    return rows.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(by, "r.*")


def bets(matches: DataFrame, *keep: str) -> DataFrame:
    """Three one-unit bets per match: ``outcome``, ``price``, ``won``."""
    trio = F.array("p1", "px", "p2")
    return (matches.select(*keep, "winner", F.posexplode(trio).alias("outcome", "price"))
            .withColumn("won", F.col("outcome") == F.col("winner")))


def flat_return(price="price", won="won") -> list[Column]:
    """Count, mean gain and 95 % margin of a one-unit stake; empty gives zeros."""
    gain = F.when(F.col(won), F.col(price)).otherwise(F.lit(0.0))
    n = F.count(F.col(price))
    return [n.alias("n"), F.coalesce(F.avg(gain), F.lit(0.0)).alias("mean_return"),
            F.coalesce(1.96 * F.sqrt(F.var_pop(gain) / n), F.lit(0.0)).alias("margin")]


def band_of(price: Column, bands=BANDS) -> Column:
    chain = None
    for low, high in bands:
        hit = (price >= low) & (price < high)
        chain = F.when(hit, F.lit(low)) if chain is None else chain.when(hit, F.lit(low))
    return chain


def banded_return(matches: DataFrame, bands=BANDS, min_bets: int = MIN_BETS, where: Column | None = None) -> DataFrame:
    rows = matches if where is None else matches.where(where)
    high = F.create_map(*[F.lit(x) for pair in bands for x in pair])
    return (bets(rows).withColumn("band_low", band_of(F.col("price"), bands)).where("band_low IS NOT NULL")
            .groupBy("band_low").agg(*flat_return(), F.avg(F.col("won").cast("double")).alias("win_rate"))
            .where(F.col("n") >= min_bets)
            .withColumn("band_high", F.element_at(high, F.col("band_low"))))


def _side(condition: Column, name: str) -> list[Column]:
    gain = F.when(condition, F.when(F.col("won"), F.col("price")).otherwise(F.lit(0.0)))
    n = F.count(gain)
    return [n.alias(f"n_{name}"), F.coalesce(F.avg(gain), F.lit(0.0)).alias(f"{name}_return"),
            F.coalesce(1.96 * F.sqrt(F.var_pop(gain) / n), F.lit(0.0)).alias(f"{name}_margin")]


def favourite_longshot(matches: DataFrame, by: str, min_matches: int) -> DataFrame:
    """Return of short against long prices per group, groups with enough matches only."""
    per_bet = bets(matches, by)
    third = F.count("*") / 3
    home = F.count_if((F.col("outcome") == 0) & F.col("won"))
    return (per_bet.groupBy(by).agg(
        third.cast("long").alias("n_matches"), (home / third).alias("home_rate"),
        *_side(F.col("price") < FAVOURITE_BELOW, "favourite"),
        *_side(F.col("price") >= LONGSHOT_FROM, "longshot"))
        .where(F.col("n_matches") >= min_matches))


def calibration(matches: DataFrame, by: str, buckets: int = 20) -> DataFrame:
    """Observed frequency per implied-probability bucket and the mean margin per source."""
    probs = P.implied_probs("p1", "px", "p2")
    rows = matches.select(by, "winner", P.overround("p1", "px", "p2").alias("over"),
                          F.posexplode(probs).alias("outcome", "p"))
    bucket = F.least(F.floor(F.col("p") * buckets), F.lit(buckets - 1)).cast("int")
    return rows.groupBy(by, bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_p"),
        F.avg((F.col("outcome") == F.col("winner")).cast("double")).alias("observed"),
        F.avg("over").alias("mean_overround"))


def fully_priced(matches: Column, plausible: bool = True) -> Column:
    """Every match of a pool has a price."""
    test = P.plausible_market if plausible else (lambda a, b, c: a.isNotNull() & b.isNotNull() & c.isNotNull())
    return (F.size(matches) > 0) & F.forall(matches, lambda m: test(m["p1"], m["px"], m["p2"]))


def combo_retentions(pools: DataFrame, *keep: str) -> DataFrame:
    """Retention of the equivalent combined bet, fully priced pools; the outcome is not needed."""
    return pools.where(fully_priced(F.col("matches"))).select(
        *keep, P.combo_retention(F.col("matches")).alias("retention"))


def combo_quantiles(retentions: DataFrame, min_pools: int = MIN_COMBO_POOLS) -> DataFrame:
    """Exact quartile elements of the retention and how a pool compares with the median combo."""
    n = F.col("n")
    stats = order_statistics(retentions, "retention", {
        "q1": (0.25, F.floor(n / 4)), "median": (0.5, F.floor(n / 2)), "q3": (0.75, F.floor(n * 3 / 4))})
    return stats.where(n >= min_pools).withColumn("pool_over_combo", F.lit(POOL_RETURN) / F.col("median"))
