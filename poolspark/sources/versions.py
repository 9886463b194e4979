"""A versioned, bucketed table: an append log, compacted bases and a latest view.

Rows live in buckets of their key. Every write is one version of the log and never changes another; a version written
again (a replayed micro-batch) replaces itself. ``compact`` reduces what is known of each bucket to a base and marks how
far that base goes, and only then do readers use it: a view is the marked base of each bucket and the versions after the mark.
Readers that know their keys read only the buckets of those.

Layout below ``path``: ``log/version=V/bucket=B``, ``base/upto=V/bucket=B`` and ``marks/upto=V`` (one row per bucket).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce as fold
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from poolspark.sources.readers import lookup

BUCKETS = 64


class Versions:
    """``reduce`` takes rows with their ``version`` and gives those that still matter, in the schema of the table and with ``version``.

    It must give the same for parts reduced before as for all rows together.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: Sequence[str],
                 reduce: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.reduce, self.buckets = spark, path, list(key), reduce, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame, version: int) -> None:
        names = self.schema.fieldNames()
        (rows.select(*names).withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/log/version={version}"))

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys of ``rows``: at most ``buckets`` numbers reach the driver."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def marks(self) -> dict[int, int]:
        """Version up to which each bucket is compacted."""
        found = lookup(self.spark, f"{self.path}/marks", "bucket int, upto int")
        return dict(found.groupBy("bucket").agg(F.max("upto")).collect())

    def history(self) -> DataFrame:
        """Every row ever written, with its version: the log is never rewritten."""
        return self._scan("log", "version")

    def rows(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows that matter, of all or of the given buckets, with their version."""
        wanted = list(range(self.buckets)) if buckets is None else list(buckets)
        marks = self.marks()
        by_mark: dict[int, list[int]] = {}
        for b in wanted:
            by_mark.setdefault(marks.get(b, -1), []).append(b)

        def part(test: Callable[[int], Column]) -> Column:
            # Conditions on folder names: whole folders are left out before anything is read.
            return fold(or_, [F.col("bucket").isin(bs) & test(mark) for mark, bs in by_mark.items()], F.lit(False))

        log = self._scan("log", "version").where(part(lambda m: F.col("version") > m))
        base = self._scan("base", "upto", "version int").where(part(lambda m: F.col("upto") == m)).drop("upto")
        return self.reduce(log.unionByName(base).drop("bucket"))

    def compact(self, upto: int, buckets: Iterable[int] | None = None) -> None:
        """Write the bases of the buckets as of version ``upto``, then their marks."""
        chosen = list(range(self.buckets)) if buckets is None else list(buckets)
        rows = self.rows(chosen).where(F.col("version") <= upto).withColumn("bucket", self.bucket())
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/upto={upto}")
        self.spark.createDataFrame([(b,) for b in chosen], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/upto={upto}")

    def _scan(self, part: str, level: str, more: str = "") -> DataFrame:
        extra = ", ".join(x for x in (more, f"{level} int, bucket int") if x)
        schema = StructType(self.schema.fields + self.spark.createDataFrame([], extra).schema.fields)
        return lookup(self.spark, f"{self.path}/{part}", schema)


def newest_rows(*key: str) -> Callable[[DataFrame], DataFrame]:
    """Reduce to the row of the highest version per key."""

    def pick(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in key]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*key, "r.*")

    return pick


def last_observations(key: Sequence[str], order: str, ok: Column) -> Callable[[DataFrame], DataFrame]:
    """Reduce to two observations per key, the latest and the latest plausible one: all that the retention rule needs."""

    def pick(rows: DataFrame) -> DataFrame:
        rest = F.struct(*[c for c in rows.columns if c not in key])
        both = rows.groupBy(*key).agg(F.max_by(rest, F.col(order)).alias("latest"), F.max_by(rest, F.when(ok, F.col(order))).alias("good"))
        kept = F.array_distinct(F.array_compact(F.array("latest", "good")))
        return both.select(*key, F.explode(kept).alias("r")).select(*key, "r.*").select(*rows.columns)

    return pick
