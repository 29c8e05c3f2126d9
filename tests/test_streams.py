"""Bucket tables, state that ends, and late data."""

import os

import pytest
from pyspark.sql import functions as F

from panelyard.streaming import incremental as I  # noqa: E741
from panelyard.streaming.sinks import BucketTable

EVENTS = "event_id long, user_id long, event_type string, ts timestamp, value double, props string"


def newest(rows):
    return rows.groupBy("k").agg(F.max_by("v", "at").alias("v"), F.max("at").alias("at"))


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, f"{tmp_path}/t", ["k"], newest, spark.createDataFrame([], "k long, v string, at int").schema, 4)


def batch(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, at int")


def state(table):
    return {(x.k, x.v, x["at"]) for x in table.read().collect()}


def test_a_crash_before_the_manifest_loses_nothing(spark, table):
    table.apply(batch(spark, [(k, "a", 1) for k in range(20)]), 0)
    before = state(table)
    second = batch(spark, [(3, "b", 2), (3, "c", 3), (50, "new", 1), (4, "old", 0)])
    table.write_data(second, 1)
    assert state(table) == before
    # the batch runs again, and once more after it has finished
    want = {(k, "a", 1) for k in range(20) if k != 3} | {(3, "c", 3), (50, "new", 1)}
    for _ in range(2):
        table.apply(second, 1)
        assert state(table) == want


def test_reads_follow_the_keys(spark, table):
    for n in range(6):
        table.apply(batch(spark, [(k, f"v{n}", n) for k in range(10)]), n)
        assert len(table.read().inputFiles()) <= 4
    assert {x.v for x in table.read().collect()} == {"v5"}
    left = sorted(os.listdir(f"{table.where}/data"))
    assert [x for x in left if x.startswith("batch")] == ["batch=4", "batch=5"]
    table.apply(batch(spark, []), 6)
    assert len(state(table)) == 10


def days(spark, folder, name, rows):
    """One file of events: (id, user, day)."""
    made = spark.createDataFrame([(i, u, "view", None, 1.0, "{}", d) for i, u, d in rows], "event_id long, user_id long, event_type string, ts timestamp, value double, props string, day int")
    made = made.withColumn("ts", F.timestamp_add("DAY", "day", F.lit("2024-01-01").cast("timestamp"))).drop("day")
    made.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    part = next(x for x in os.listdir(f"{folder}/{name}") if x.endswith(".parquet"))
    os.makedirs(f"{folder}/in", exist_ok=True)
    os.rename(f"{folder}/{name}/{part}", f"{folder}/in/{name}.parquet")


def test_state_of_dedup_ends_and_late_repeats_are_dropped(spark, tmp_path):
    for k in range(8):
        days(spark, tmp_path, f"f{k}", [(10 * k + u, 100 * k + u, 10 * k) for u in range(5)] + [(10 * k + 9, 0, 10 * k)])
    stream = I.first_seen(I.event_stream(spark, f"{tmp_path}/in", "*.parquet", 1), ("user_id",), "14 days")
    seen = []
    query = I.drain(stream.writeStream.foreachBatch(lambda b, n: seen.extend(b.collect())), f"{tmp_path}/w")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # 41 keys in all; the state keeps those of the last files only
    assert max(held) <= 25 < len({x.user_id for x in seen})
    # user 0 repeats at every file: known to the state for two weeks, then seen as new
    assert 1 < sum(x.user_id == 0 for x in seen) < 8
    got = I.stream_dedup(spark, f"{tmp_path}/in", f"{tmp_path}/d", ("user_id",), glob="*.parquet", files=1)
    assert sorted(x.user_id for x in got.collect()) == sorted({x.user_id for x in seen})


def test_counts_and_upsert_in_many_batches(spark, tmp_path):
    for k in range(4):
        days(spark, tmp_path, f"f{k}", [(10 * k + u, u, 3 * k + u % 2) for u in range(4)])
    folder = f"{tmp_path}/in"
    rows = spark.read.parquet(folder)
    week = F.date_trunc("week", "ts").cast("date")
    want = {(x.w, x["count"]) for x in rows.groupBy(week.alias("w")).count().collect()}
    got = I.stream_weekly_counts(spark, folder, f"{tmp_path}/c", "*.parquet", 1)
    assert {(x.week_start, x.n) for x in got.collect()} == want
    last = I.stream_upsert(spark, folder, f"{tmp_path}/u", "*.parquet", 1)
    assert {(x.user_id, x.event_id) for x in last.collect()} == {(u, 30 + u) for u in range(4)}
    # a later run goes on from the state and the manifest
    days(spark, tmp_path, "f4", [(99, 1, 20)])
    again = I.stream_upsert(spark, folder, f"{tmp_path}/u", "*.parquet", 1)
    assert {(x.user_id, x.event_id) for x in again.collect()} == {(0, 30), (1, 99), (2, 32), (3, 33)}
