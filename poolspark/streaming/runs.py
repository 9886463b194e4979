"""Streaming runs: every query writes to files and reads its result back as a frame.

State lives in Spark's state store and in the shared checkpoint folder, so a lost executor or a
restarted driver resumes where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from poolspark.functions.prices import plausible_market
from poolspark.session import ensure_checkpoint_dir
from poolspark.sources.readers import lookup
from poolspark.sources.versions import BUCKETS, Versions, newest_rows
from poolspark.streaming import frames as X
from poolspark.streaming.stateful import complete_records, keyed_state, newest, plausible_prices


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str, mode: str = "append", trigger: dict | None = None) -> DataFrame:
    """Run an append stream over everything available and return what it wrote."""
    spark = stream.sparkSession
    folder = workspace(spark, name)
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/state").trigger(**(trigger or {"availableNow": True})).start())
    query.awaitTermination()
    return lookup(spark, f"{folder}/out", stream.schema)


def upsert(stream: DataFrame, name: str, merge: Callable[[DataFrame], DataFrame], shape: Callable[[DataFrame], DataFrame] = lambda rows: rows,
           report: list | None = None, mode: str = "append") -> DataFrame:
    """Run a stream of changed rows and return the last version of every key.

    Each micro-batch writes its changed rows, put into ``shape``, under its own batch number (a replayed batch overwrites
    itself); ``merge`` reduces the versions. ``report`` gets the progress of every micro-batch.
    """
    spark = stream.sparkSession
    folder = workspace(spark, name)

    def store(rows: DataFrame, batch: int) -> None:
        shape(rows).withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/out/part={batch}")

    with keyed_state(spark):
        query = (stream.writeStream.outputMode(mode).foreachBatch(store)
                 .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
        query.awaitTermination()
    if report is not None:
        report.extend(query.recentProgress)
    return merge(_versions(spark, folder, shape(spark.createDataFrame([], stream.schema)).schema))


def _versions(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Rows of all micro-batches with their batch number; an empty frame where no batch ran."""
    return lookup(spark, f"{folder}/out", StructType(schema.fields + [StructField("batch", IntegerType())])).drop("part")


def last_version(*key: str) -> Callable[[DataFrame], DataFrame]:
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*key, "batch")]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")

    return merge


def accumulate_frames(stream: DataFrame, body: str = "body", seq: str = "seq") -> DataFrame:
    """Last entry per pool and match of a frame stream, kept in the state store until its time to live is over."""
    return upsert(newest(X.entries(stream, body, seq), seq), "frames", last_version("kind", "id"))


def keep_plausible(stream: DataFrame, key=("pool_id", "match_id"), order=("seq",), stamp: str = "collected_at") -> DataFrame:
    """Streaming twin of the retention rule: two observations per match in the state store.

    Snapshots older than the stored ones cannot win whatever their order of arrival.
    """
    changes = plausible_prices(stream, list(key), list(order), stamp, plausible_market("p1", "px", "p2"))
    return upsert(changes, "retention", last_version(*key))


def emit_complete(stream: DataFrame, body: str = "body", seq: str = "seq", settled: tuple[str, ...] = (), report: list | None = None) -> DataFrame:
    """Pools stored as soon as their row and all their matches have arrived; the last version of each.

    A match entry is routed to the pools that list it and a pool holds what it waits for (``streaming/stateful.py``), so
    a micro-batch reads its own frames and the state of their keys, whatever came before. A pool whose status is in
    ``settled`` is stored a last time and forgotten.
    """
    records = complete_records(X.entries(stream, body, seq), seq, settled)
    return upsert(records, "complete", last_version("global_id"), X.composed, report)


class IndexRefresh:
    """Incremental run, then index rebuild: stored rows and the index as versioned tables, both by pool.

    A micro-batch is stored under its number, the pools it touches are read back whole (from the buckets that hold them)
    and only they are indexed again. A pool that comes in several parts is complete after the last; a batch that is run again
    replaces its own rows and gives the same index.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: list[str], pool: Column,
                 build: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        """``pool`` is a row's pool, ``key`` names a row, ``build`` makes index rows (``id``) of all rows of some pools."""
        self.build, self.pool = build, pool
        stored = StructType([StructField("__pool", LongType()), *schema.fields])
        self.rows = Versions(spark, f"{folder}/rows", stored, ["__pool"], newest_rows("__pool", *key), buckets)
        shape = build(spark.createDataFrame([], schema)).schema
        self.index = Versions(spark, f"{folder}/index", shape, ["id"], newest_rows("id"), buckets)

    def step(self, batch_rows: DataFrame, batch: int) -> None:
        named = batch_rows.withColumn("__pool", self.pool.cast("long"))
        self.rows.append(named, batch)
        written = self.rows.history().where(F.col("version") == batch)
        touched = written.select("__pool").distinct()
        whole = self.rows.rows(self.rows.touched(written)).join(touched, "__pool", "left_semi")
        self.index.append(self.build(whole.drop("__pool", "version")), batch)

    def current(self) -> DataFrame:
        return self.index.rows().drop("version")


def refresh_index(stream: DataFrame, key: list[str], pool: Column, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``IndexRefresh`` over everything available and return the index."""
    folder = workspace(stream.sparkSession, "index")
    run = IndexRefresh(stream.sparkSession, folder, stream.schema, key, pool, build)
    query = (stream.writeStream.foreachBatch(run.step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return run.current()


def activity(stream: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes", *by: str) -> DataFrame:
    """Event-time windows with a watermark; every window with an event is in the result, the last ones too.

    A micro-batch hands on the windows it changed and their last version counts. A window whose end is ``late`` behind
    the newest event is final and leaves the state.
    """
    windowed = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by)
    counted = windowed.agg(F.count("*").alias("events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return upsert(counted.select(F.col("w.start").alias("start"), *by, "events", "cents"), "activity", last_version("start", *by), mode="update")


def sessions(stream: DataFrame, key: str, ts: str = "ts", gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions per key closed by a gap without events."""
    counted = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("events"))
    return drain(counted.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events"), "sessions")
