"""Genre of every pool from the competitions of its matches, and corpus tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolspark.functions import categories as C


def _counter(values: Column) -> Column:
    """``map value -> occurrences`` of a short array, nulls dropped."""
    known = F.array_compact(values)
    return F.map_from_entries(F.transform(F.array_distinct(known), lambda v: F.struct(
        v, F.size(F.filter(known, lambda w: w == v)).cast("long"))))


def categorise(pools: DataFrame, matches: str = "matches", key=("pool_type", "pool_id")) -> DataFrame:
    """Category, genre and counters per pool; row-level, nothing is shuffled.

    A pool of one competition takes its readable name unless too few matches are named.
    """
    named = pools.select(*key, F.size(matches).cast("long").alias("n"),
                         F.transform(matches, lambda m: F.nullif(m["competition"], F.lit(""))).alias("codes"))
    rows = named.withColumn("fams", F.array_compact(F.transform("codes", lambda c: C.family(c))))
    names = F.map_keys("precise")
    readable = F.transform_keys("precise", lambda k, _: C.readable(k))
    single = F.when(F.size(names) == 1, C.readable(names[0]))
    genre = C.genre(F.col("fams"), F.col("n"))
    return (rows.withColumn("precise", _counter(F.col("codes"))).withColumn("family", genre)
            .select(*key, F.when(single.isNotNull() & (F.col("family") != C.UNDETERMINED), single)
                    .otherwise(F.col("family")).alias("category"), "family",
                    _counter(F.col("fams")).alias("families"), readable.alias("competitions"), "n",
                    F.size("fams").cast("long").alias("named"), single.alias("single")))


def genre_tally(categories: DataFrame) -> DataFrame:
    total = categories.agg(F.count("*")).scalar()
    return (categories.groupBy("family").agg(F.count("*").alias("pools"))
            .withColumn("share", F.col("pools") / total * 100))


def single_competition_tally(categories: DataFrame) -> DataFrame:
    return categories.where("single IS NOT NULL").groupBy("single").agg(F.count("*").alias("pools"))


def competition_tally(categories: DataFrame, top: int | None = None) -> DataFrame:
    """Competitions by number of matches; ``top`` keeps the screen form, ties by name."""
    rows = (categories.select(F.explode("competitions").alias("competition", "c"))
            .groupBy("competition").agg(F.sum("c").alias("matches")))
    return rows if top is None else rows.orderBy(F.desc("matches"), "competition").limit(top)
