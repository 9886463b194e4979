"""Keyed state of the streams: prices kept, matches routed to their pools, pools held until they are complete.

Every processor keeps one small record per key in the state store, so a micro-batch touches the keys it brings and
nothing of the history. State ends by itself: a settled pool clears its own and its matches' interest in it, a timer drops a
pool that stays incomplete, and every value has a time to live.

An order is any text that sorts like the order of observation (``order_key``); what is older than the state is ignored,
so the order of arrival does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructType, TimestampType

# Keyed processors need this store; without data no batch is due, else a run over all available data would never end
# while timers are possible. Expired state is cleared by the next batch that has data.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
_DIGITS = 20
DAY_MS = 24 * 3600 * 1000
TTL_MS = 60 * DAY_MS  # what is never settled is forgotten after two months
GRACE_MS = 2 * DAY_MS  # how long a settled pool may wait for its last matches


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside run with the settings that keyed processors need."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def order_key(df: DataFrame, *columns: str) -> Column:
    """Text that sorts like the columns: whole numbers from 0 on, times, texts, or structs of these, first column first."""

    def of(column: Column, kind) -> list[Column]:
        if isinstance(kind, StructType):
            return [p for f in kind.fields for p in of(column[f.name], f.dataType)]
        if isinstance(kind, StringType):
            return [column]
        number = F.unix_micros(column) if isinstance(kind, TimestampType) else column.cast("bigint")
        return [F.lpad(number.cast("string"), _DIGITS, "0")]

    parts = [p for c in columns for p in of(F.col(c), df.schema[c].dataType)]
    return F.concat_ws("\u0001", *parts)


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for frame in frames:
        yield from frame.to_dict("records")


def newest_of(rows: DataFrame, *key: str) -> DataFrame:
    """Rows without those that a newer one (``at``) of their key in the same piece of a task outdates.

    What is older than the state is ignored anyhow, so only fewer rows reach a key that very many frames bring.
    """
    places = [rows.columns.index(c) for c in (*key, "at")]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = pa.table([*[batch.column(p) for p in places], pa.array(np.arange(batch.num_rows))],
                             names=[*[f"k{i}" for i in range(len(key))], "at", "row"])
            # Among equal ones the last: it would overwrite the others.
            order = order.sort_by([*[(f"k{i}", "ascending") for i in range(len(key))], ("at", "ascending"), ("row", "ascending")])
            last = np.ones(order.num_rows, bool)
            if order.num_rows > 1:
                same = np.ones(order.num_rows - 1, bool)
                for i in range(len(key)):
                    codes = pc.rank(order.column(f"k{i}").combine_chunks(), tiebreaker="dense").to_numpy()
                    same &= codes[1:] == codes[:-1]
                last[:-1] = ~same
            yield batch.take(pa.array(np.sort(order.column("row").to_numpy()[last])))

    return rows.mapInArrow(pick, rows.schema)


class Newest(StatefulProcessor):
    """The newest text per key; a row leaves whenever it changes."""

    def __init__(self, ttl_ms: int = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at string, payload string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kind, ident = key
        best = max(((r["at"], r["payload"]) for r in _rows(rows)), key=lambda r: r[0])
        if not self.newest.exists() or self.newest.get()[0] <= best[0]:
            self.newest.update(best)
            yield pd.DataFrame({"kind": [kind], "id": [ident], "at": [best[0]], "payload": [best[1]]})

    def close(self) -> None:
        pass


PRICE_STATE = "good_at string, latest_at string, good_p1 double, good_px double, good_p2 double, good_stamp timestamp, p1 double, px double, p2 double, stamp timestamp"


class KeepPlausible(StatefulProcessor):
    """Latest plausible price of a match, and the latest of all: two observations, whatever has been seen.

    Input rows are one observation each with ``ok`` (plausible) and ``at``; a row leaves whenever the record changes.
    """

    def __init__(self, columns: list[str], ttl_ms: int = TTL_MS):
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", PRICE_STATE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.record.get() if self.record.exists() else None
        good_at, latest_at, *rest = held if held else (None,) * 10
        good, latest = list(rest[:4]), list(rest[4:])
        changed = False
        for row in _rows(rows):
            seen = [None if pd.isna(row[c]) else row[c] for c in ("p1", "px", "p2", "stamp")]
            if latest_at is None or row["at"] >= latest_at:
                latest_at, latest, changed = row["at"], seen, True
            if row["ok"] and (good_at is None or row["at"] >= good_at):
                good_at, good, changed = row["at"], seen, True
        if not changed:
            return
        self.record.update((good_at, latest_at, *good, *latest))
        kept = good if good_at is not None else latest
        late = good[3] if good_at is not None and good_at != latest_at else None
        values = [*key, *kept[:3], late, latest[3]]
        yield pd.DataFrame({c: pd.Series([v], dtype=object) for c, v in zip(self.columns, values)})

    def close(self) -> None:
        pass


class RouteMatches(StatefulProcessor):
    """Keyed by match: the newest entry of the match and the pools that list it; both meet here, in either order.

    Input: ``pool`` null for an entry of the match itself, else the pool that lists it, with ``settled`` once it is over.
    Output: one row per pool that has to hear of the entry. A settled pool is told a last time and forgotten.
    """

    def __init__(self, ttl_ms: int = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "at string, payload string", self.ttl_ms)
        self.pools = handle.getMapState("pools", "pool bigint", "at string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        entry = self.entry.get() if self.entry.exists() else None
        news, listed = False, {}
        for row in _rows(rows):
            if pd.isna(row["pool"]):
                if entry is None or row["at"] >= entry[0]:
                    entry, news = (row["at"], row["payload"]), True
            elif int(row["pool"]) not in listed or row["at"] >= listed[int(row["pool"])][0]:
                listed[int(row["pool"])] = (row["at"], bool(row["settled"]))
        if news:
            self.entry.update(entry)
        told = set(listed)
        if news and self.pools.exists():
            told |= {int(k[0]) for k in self.pools.keys()}
        for pool, (at, settled) in listed.items():
            if settled:
                if self.pools.containsKey((pool,)):
                    self.pools.removeKey((pool,))
            else:
                self.pools.updateValue((pool,), (at,))
        if entry is not None and told:
            yield pd.DataFrame({"pool": sorted(told), "match_id": int(key[0]), "at": entry[0], "payload": entry[1]})

    def close(self) -> None:
        pass


class HoldPools(StatefulProcessor):
    """Keyed by pool: its own newest row, the matches it waits for and those that have come.

    A record leaves as soon as the row and all listed matches are there, and again with every change; a pool without
    matches never leaves. A settled pool leaves a last time and its state is cleared; if matches are still missing, a timer
    clears it after ``grace_ms``.
    """

    def __init__(self, ttl_ms: int = TTL_MS, grace_ms: int = GRACE_MS):
        self.ttl_ms, self.grace_ms = ttl_ms, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pool = handle.getValueState("pool", "at string, payload string, wanted string, settled boolean", self.ttl_ms)
        self.pending = handle.getMapState("pending", "match_id bigint", "listed boolean", self.ttl_ms)
        self.matches = handle.getMapState("matches", "match_id bigint", "at string, payload string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.pool.get() if self.pool.exists() else None
        pool, came = held, {}
        for row in _rows(rows):
            if pd.isna(row["match_id"]):
                if pool is None or row["at"] >= pool[0]:
                    pool = (row["at"], row["payload"], row["wanted"], bool(row["settled"]))
            elif int(row["match_id"]) not in came or row["at"] >= came[int(row["match_id"])][0]:
                came[int(row["match_id"])] = (row["at"], row["payload"])
        wanted = [int(x) for x in pool[2].split(",")] if pool is not None and pool[2] else []
        if pool is not None and pool != held:
            self.pool.update(pool)
            old = set(int(x) for x in held[2].split(",")) if held is not None and held[2] else set()
            for gone in old - set(wanted):
                for state in (self.pending, self.matches):
                    if state.containsKey((gone,)):
                        state.removeKey((gone,))
            for ident in set(wanted) - old:
                if not self.matches.containsKey((ident,)):
                    self.pending.updateValue((ident,), (True,))
        for ident, (at, payload) in came.items():
            if not self.matches.containsKey((ident,)) or self.matches.getValue((ident,))[0] <= at:
                self.matches.updateValue((ident,), (at, payload))
            if self.pending.containsKey((ident,)):
                self.pending.removeKey((ident,))
        waiting = self.pending.exists() and next(iter(self.pending.keys()), None) is not None
        if pool is None or not wanted or waiting:
            if pool is not None and pool[3] and pool != held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.grace_ms)
            return
        lines = [{"match_id": ident, "payload": self.matches.getValue((ident,))[1]} for ident in wanted]
        yield pd.DataFrame({"id": [int(key[0])], "payload": [pool[1]], "lines": [lines]})
        if pool[3]:
            self._clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._clear()
        return iter(())

    def _clear(self) -> None:
        for state in (self.pool, self.pending, self.matches):
            state.clear()

    def close(self) -> None:
        pass


def newest(rows: DataFrame, seq: str, ttl_ms: int = TTL_MS) -> DataFrame:
    """Changes of the newest payload per ``kind`` and ``id``."""
    keyed = newest_of(rows.select("kind", "id", order_key(rows, seq).alias("at"), "payload").where("id IS NOT NULL"), "kind", "id")
    return keyed.groupBy("kind", "id").transformWithStateInPandas(
        Newest(ttl_ms), "kind string, id bigint, at string, payload string", "Append", "ProcessingTime")


def complete_records(entries: DataFrame, seq: str, settled: tuple[str, ...], ttl_ms: int = TTL_MS, grace_ms: int = GRACE_MS) -> DataFrame:
    """(``id``, ``payload``, ``lines``) of every pool that is complete, again whenever it changes; ``settled`` names final statuses."""
    keyed = newest_of(entries.select("kind", "id", order_key(entries, seq).alias("at"), "payload").where("id IS NOT NULL"), "kind", "id")
    listing = F.from_json("payload", "poolStatus string, matches array<bigint>")
    pools = keyed.where("kind = 'pool'").withColumn("p", listing).select(
        "id", "at", "payload", F.array_compact(F.array_distinct(F.coalesce("p.matches", F.array().cast("array<bigint>")))).alias("wanted"),
        F.coalesce(F.col("p.poolStatus").isin(list(settled)), F.lit(False)).alias("settled"))
    none = lambda kind: F.lit(None).cast(kind)
    heard = keyed.where("kind = 'match'").select(F.col("id").alias("match_id"), none("bigint").alias("pool"), "at", "payload", F.lit(False).alias("settled"))
    asked = pools.select(F.explode("wanted").alias("match_id"), F.col("id").alias("pool"), "at", none("string").alias("payload"), "settled")
    routed = heard.unionByName(asked).groupBy("match_id").transformWithStateInPandas(
        RouteMatches(ttl_ms), "pool bigint, match_id bigint, at string, payload string", "Append", "ProcessingTime")
    rows = pools.select(F.col("id").alias("pool"), none("bigint").alias("match_id"), "at", "payload", F.array_join("wanted", ",").alias("wanted"), "settled")
    told = routed.select("pool", "match_id", "at", "payload", none("string").alias("wanted"), F.lit(False).alias("settled"))
    return rows.unionByName(told).groupBy("pool").transformWithStateInPandas(
        HoldPools(ttl_ms, grace_ms), "id bigint, payload string, lines array<struct<match_id:bigint,payload:string>>", "Append", "ProcessingTime")


def plausible_prices(snapshots: DataFrame, key: list[str], order: list[str], stamp: str, ok: Column, ttl_ms: int = TTL_MS) -> DataFrame:
    """Changes of the record of every key: prices kept, ``observed_at`` and ``stamp``."""
    rows = snapshots.select(*key, "p1", "px", "p2", F.col(stamp).cast("timestamp").alias("stamp"), F.coalesce(ok, F.lit(False)).alias("ok"),
                            order_key(snapshots, *order).alias("at"))
    kinds = ", ".join(f"`{k}` {snapshots.schema[k].dataType.simpleString()}" for k in key)
    return rows.groupBy(*key).transformWithStateInPandas(
        KeepPlausible([*key, "p1", "px", "p2", "observed_at", stamp], ttl_ms),
        f"{kinds}, p1 double, px double, p2 double, observed_at timestamp, `{stamp}` timestamp", "Append", "ProcessingTime")
