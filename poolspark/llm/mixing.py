"""Mixing sources to target weights: hash-random keys, sorted ranges, prefix sums and one cut per source.

Every row gets a key from a hash of its id and text. Within a source the keys order the rows at random; since they
are uniform, equal parts of their range ("slices") hold about equally many rows, so a source of any size is sorted
slice by slice, and the words before a slice come from the totals of the slices. The slices are as many as the root of
the number of rows, so neither a slice nor the list of slices of a source outgrows a task. The words before each row give the place where a source reaches its budget: whole epochs first, then the rows before the cut once more, and of the row
at the cut as many words as are left.

The rest is decided without moving texts: a row compares its key with the cut of its source.

Defined cases: a null text has no words; rows without words are taken 0 times; a null source is a source of its own,
ordered last; a null id is hashed as if it were missing; rows equal in id, text and source share what is left at a cut
evenly, rounded down; an empty table gives no rows. Columns of ``docs`` that are called like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolspark.llm.store import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
_DIGITS = 15  # hexadecimal digits of a key: 60 bits


def shuffle_key(seed: str, doc_id: str = "doc_id", text: str = "text") -> Column:
    """Hash-random 60-bit key of a row; the same in every run."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(doc_id).cast("string"), F.col(text)))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    The budget is ``share`` (a fraction) of all words. Sources get it by weight; none gets more than ``most`` times its
    own words, and what it cannot take goes to the others by weight. A source is full exactly where the share that
    fills it, given to all, does not exceed the budget: one running sum over the sources in the order of words per
    weight replaces the rounds of handing on. The table has one row per source, a few words each.
    """
    num, den = share
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(int(w)) for w in weights])
    exact = "decimal(38,0)"
    per_weight = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = per_weight.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = totals.withColumn("weight", F.element_at(kinds, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    for name, value, frame in (("filled", "cap", before), ("used", "weight", before), ("words", "source_size", every), ("weights", "weight", every)):
        ranked = ranked.withColumn(name, F.coalesce(F.sum(value).over(frame), F.lit(0)).cast(exact))
    given = F.col("filled") * F.col("weight") + F.col("cap") * (F.col("weights") - F.col("used"))
    full = given * den <= F.col("words") * num * F.col("weight")
    marked = ranked.withColumn("full", full)
    for name, value in (("full_words", "cap"), ("full_weight", "weight")):
        marked = marked.withColumn(name, F.coalesce(F.sum(F.when(F.col("full"), F.col(value))).over(every), F.lit(0)))
    open_words = F.col("words").cast("double") * num / den - F.col("full_words")
    open_weight = F.col("weights").cast("double") - F.col("full_weight")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(open_words * F.col("weight") / open_weight)
    return marked.select("source", "source_size", target.alias("target"))


def _slice(key: str, slices: int) -> Column:
    """Part of the key range, 0 to ``slices`` - 1."""
    return F.shiftright(F.shiftright(F.col(key), 4 * _DIGITS - 32) * F.lit(slices).cast("long"), 32)


def cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: its number of whole ``epochs``, the key and size at which the last epoch ends, and what each
    row there still gives (``left_over``).

    ``rows`` has ``source``, ``key`` and ``size``; it is read twice, so it should be a written table.
    """
    slices = math.isqrt(rows.count()) + 1
    budget = targets.select(
        F.col("source").alias("__source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor("target").cast("long")).otherwise(0).alias("__budget"))
    # Equal rows are one group, however many there are, before anything is brought together by key.
    groups = rows.groupBy("source", "key", "size").agg(F.count("*").alias("n"))
    groups = groups.withColumn("words", F.col("size") * F.col("n")).withColumn("slice", _slice("key", slices))
    inside = Window.partitionBy("source", "slice").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = groups.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slice_totals = rows.withColumn("slice", _slice("key", slices)).groupBy("source", "slice").agg(F.sum("size").alias("words"))
    offsets = slice_totals.select(F.col("source").alias("__of"), F.col("slice").alias("__slice"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    placed = local.join(offsets, F.col("source").eqNullSafe(F.col("__of")) & (F.col("slice") == F.col("__slice")))
    before = F.col("ahead") + F.col("inside")
    rest = F.col("__budget") % F.col("source_size")
    hit = placed.select("source", "key", "size", "n", "words", before.alias("before")).join(
        budget, F.col("source").eqNullSafe(F.col("__source"))).where(
        (F.col("source_size") > 0) & (F.col("before") <= rest) & (rest < F.col("before") + F.col("words")))
    hit = hit.select(F.col("__source").alias("__at"), "key", "size", F.floor((rest - F.col("before")) / F.col("n")).cast("long").alias("left_over"))
    return budget.join(hit, F.col("__source").eqNullSafe(F.col("__at")), "left").select(
        F.col("__source").alias("source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("__budget") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
        F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.coalesce("left_over", F.lit(0)).alias("left_over"))


_MADE = ["size", "source_size", "target", "taken"]


def _measured(docs: DataFrame, seed: str) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.drop(*_MADE, "__size", "__key").withColumn("__size", words).withColumn("__key", shuffle_key(seed))


def _plan(docs: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(ids with source, key and size; cuts), both written: the one pass over the texts."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "mix")
    _measured(docs.select("doc_id", "text", "source"), seed).select("doc_id", "source", "__key", "__size").write.parquet(f"file://{folder}/rows")
    written = spark.read.parquet(f"file://{folder}/rows")
    rows = written.select("source", F.col("__key").alias("key"), F.col("__size").alias("size"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    source_targets(totals, weights, share, most).write.parquet(f"file://{folder}/targets")
    cuts(rows, spark.read.parquet(f"file://{folder}/targets")).withColumnRenamed("source", "__source").write.parquet(f"file://{folder}/cuts")
    # A file of one row per source: Spark broadcasts it as long as it is small enough.
    return written, spark.read.parquet(f"file://{folder}/cuts")


def _decided(rows: DataFrame, cut: DataFrame, kept: Sequence[str]) -> DataFrame:
    ahead = (F.col("__key") < F.col("cut_key")) | ((F.col("__key") == F.col("cut_key")) & (F.col("__size") < F.col("cut_size")))
    at_cut = (F.col("__key") == F.col("cut_key")) & (F.col("__size") == F.col("cut_size"))
    last = F.when(ahead, F.col("__size")).when(at_cut, F.col("left_over")).otherwise(0)
    taken = F.col("epochs") * F.col("__size") + last
    return rows.join(cut, F.col("source").eqNullSafe(F.col("__source"))).select(
        *[F.col(c) for c in kept], F.col("__size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def allot(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix") -> DataFrame:
    """(``doc_id``, ``size``, ``source_size``, ``target``, ``taken``) of every row, without its text.

    ``weights`` are dealt to the sources by name, again and again; ``share`` is the fraction of all words to take; ``most``
    bounds how often a word is taken. Only ids, keys and sizes are written and shuffled.
    """
    rows, cut = _plan(docs, weights, share, most, seed)
    return _decided(rows, cut, ["doc_id"])


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix") -> DataFrame:
    """``docs`` whole (``doc_id``, ``text``, ``source`` and any others) with the columns of ``allot``; texts are not shuffled."""
    cut = _plan(docs, weights, share, most, seed)[1]
    return _decided(_measured(docs, seed), cut, [c for c in docs.columns if c not in (*_MADE, "__size", "__key")])


def passes(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row per pass over a text, with ``epoch`` (from 1) and ``mixed_text``, the words taken in it.

    A whole pass gives the text unchanged; the last pass of a row at the cut gives its first words, joined by one space.
    """
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    some = mixed.where("size > 0 AND taken > 0")
    rest = (F.col("taken") % F.col("size")).cast("int")
    numbered = some.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.greatest(rest, F.lit(1))), " ")
    return numbered.withColumn("mixed_text", F.when(F.col("epoch") <= whole, F.col("text")).otherwise(part))
