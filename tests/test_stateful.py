"""Keyed stream state, versioned tables and the incremental index."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from poolspark.functions.prices import plausible_market
from poolspark.operators.matching import keep_last_plausible
from poolspark.sources import readers as R
from poolspark.sources import writers as W
from poolspark.sources.versions import Versions, last_observations, newest_rows
from poolspark.streaming import runs as S
from poolspark.streaming.stateful import order_key


def frame(pools=None, matches=None):
    return f'42["m",{json.dumps({"pools": pools or {}, "matches": matches or {}})}]'


def batches(spark, folder, parts, schema="seq int, body string"):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_pools_wait_for_their_matches(spark, tmp_path):
    """Matches before and after their pool, a shared match, a corrected listing, old news, a settled pool."""
    parts = [
        [(1, frame(matches={"1": {"competitor1Name": "A"}}))],
        [(2, frame({"7000001": {"matches": [1, 2]}, "7000002": {"matches": [2, 3]}}))],
        [(3, frame(matches={"2": {"competitor1Name": "B"}})), (0, frame(matches={"1": {"competitor1Name": "old"}}))],
        [(4, frame({"7000002": {"matches": [2]}, "7000003": {"matches": []}}))],
        [(5, frame({"7000001": {"matches": [1, 2], "poolStatus": "ENDED"}, "7000002": {"matches": [2], "poolStatus": "ENDED"}}))]]
    report = []
    got = S.emit_complete(batches(spark, tmp_path / "in", parts), settled=("ENDED",), report=report)
    assert {r.global_id: ([m.home for m in r.matches], r.status) for r in got.collect()} == {
        7000001: (["A", "B"], "ENDED"), 7000002: (["B"], "ENDED")}
    assert len(report) == 5
    # Every batch reads its own rows only (three scans of them), and what is held at the end is no settled pool.
    assert [r.numInputRows for r in report] == [3, 3, 6, 3, 3]
    held = [json.loads(r.json)["stateOperators"] for r in report]
    assert len(held[-1]) == 2 and held[-1][1]["numRowsTotal"] < held[-2][1]["numRowsTotal"]


def test_frames_from_disk_can_be_completed(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "1.txt").write_text(frame({"7000001": {"matches": [1]}}) + "\n3probe\n" + frame(matches={"1": {"competitor1Name": "A"}}) + "\n")
    assert [m.home for m in S.emit_complete(R.frame_stream(spark, str(tmp_path / "f"))).first().matches] == ["A"]
    batch = R.frames(spark, str(tmp_path / "f"))
    assert batch.count() == 3 and [r.body[:3] for r in batch.orderBy(order_key(batch, "seq")).collect()] == ["42[", "3pr", "42["]


def observations(spark, n=200):
    rows = [(7, k % 3, k % 5, k, *((1.0, 250.0, 250.0) if k % 4 == 1 else (None,) * 3 if k % 5 == 2 else (1.5 + k % 9, 3.0, 4.0))) for k in range(n)]
    return spark.createDataFrame(rows, "pool_type int, pool_id long, match_id long, seq int, p1 double, px double, p2 double").withColumn(
        "collected_at", F.timestamp_seconds("seq")).withColumn("observed_at", F.lit(None).cast("timestamp"))


def test_price_table_written_twice_compacted_and_read_back(spark, tmp_path):
    rows = observations(spark)
    table = W.price_table(spark, str(tmp_path / "t"))
    key = ["pool_type", "pool_id", "match_id"]
    want = lambda upto: {tuple(r) for r in keep_last_plausible(rows.where(F.col("seq") < upto), key, ["collected_at"]).collect()}
    assert W.latest_prices(table).count() == 0
    table.append(rows.where("seq < 60"), 0)
    table.append(rows.where("seq >= 60 and seq < 120"), 1)
    assert {tuple(r) for r in W.latest_prices(table).collect()} == want(120)
    table.compact(0, buckets=range(0, 32))
    table.compact(1, buckets=range(16, 64))
    assert set(table.marks().values()) == {0, 1}
    assert {tuple(r) for r in W.latest_prices(table).collect()} == want(120)
    table.append(rows.where("seq >= 120"), 2)
    table.append(rows.where("seq >= 120"), 2)
    assert {tuple(r) for r in W.latest_prices(table).collect()} == want(200)
    assert R.snapshots(spark, str(tmp_path / "t")).count() == 200
    one = rows.where("pool_id = 1 and match_id = 2")
    some = table.rows(table.touched(one)).where("pool_id = 1 and match_id = 2")
    assert some.count() <= 2 and len(table.touched(one)) == 1
    read = {f.split("bucket=")[1].split("/")[0] for f in some.inputFiles() if "bucket=" in f}
    assert len(read) >= 1


def test_two_observations_are_enough(spark):
    rows = observations(spark).withColumn("version", F.lit(0))
    pick = last_observations(["pool_id", "match_id"], "seq", plausible_market("p1", "px", "p2"))
    whole = {tuple(r) for r in pick(rows).collect()}
    assert {tuple(r) for r in pick(pick(rows.where("seq < 90")).unionByName(rows.where("seq >= 90"))).collect()} == whole


def test_index_of_a_pool_in_two_batches_and_of_a_batch_run_again(spark, tmp_path):
    schema = "line int, pool bigint, value int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    build = lambda lines: lines.groupBy(F.col("pool").alias("id")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    run = S.IndexRefresh(spark, str(tmp_path), rows((1, 1, 1)).schema, ["line"], F.col("pool"), build, buckets=8)
    run.step(rows((1, 1, 10), (1, 2, 5)), 0)
    run.step(rows((2, 1, 20)), 1)
    assert {tuple(r) for r in run.current().collect()} == {(1, 2, 30), (2, 1, 5)}
    run.step(rows((2, 1, 20)), 1)
    assert {tuple(r) for r in run.current().collect()} == {(1, 2, 30), (2, 1, 5)}
    run.step(rows((2, 1, 21)), 2)
    run.rows.compact(2)
    run.step(rows((3, 2, 1)), 3)
    assert {tuple(r) for r in run.current().collect()} == {(1, 2, 31), (2, 2, 6)}
    # Only touched pools were indexed in the last batch.
    assert {r.id for r in run.index.history().where("version = 3").collect()} == {2}


def test_versions_of_an_empty_table(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "none"), "id bigint, x int", ["id"], newest_rows("id"), 4)
    assert table.rows().count() == 0 and table.history().count() == 0
    table.append(spark.createDataFrame([], "id bigint, x int"), 0)
    table.compact(0)
    assert table.rows().count() == 0


def test_last_windows_are_counted_over_batches(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(base + timedelta(minutes=7 * i), "ab"[i % 2], i / 4) for i in range(90)]
    stream = batches(spark, tmp_path / "in", [rows[:30], rows[30:60], rows[60:]], "ts timestamp, kind string, value double")
    got = {(r.start, r.kind): (r.events, r.cents) for r in S.activity(stream, "ts", "1 hour", "10 minutes", "kind").collect()}
    want = {}
    for ts, kind, value in rows:
        n, cents = want.get((ts.replace(minute=0), kind), (0, 0))
        want[ts.replace(minute=0), kind] = n + 1, cents + round(value * 100)
    assert got == want
