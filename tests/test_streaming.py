"""Drained streams: several batches, late rows, restarts, sessions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from statloom.streaming import windows

SCHEMA = "user string, ts timestamp_ntz, value double"


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour, minutes=minute)


@pytest.fixture()
def folder(spark, tmp_path):
    """Three files; the last one holds a row from the first hour."""
    batches = [[("a", at(0), 1.0), ("b", at(0, 30), 2.0)], [("a", at(9), 3.0), ("a", at(9, 20), 5.0)], [("a", at(0, 10), 100.0), ("b", at(11), 4.0), (None, at(11), 7.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/day={i}"))
    return tmp_path


def stream(spark, folder, delay, one_by_one=True):
    schema = spark.createDataFrame([], SCHEMA).schema
    return windows.watermark(windows.stream_files(spark, str(folder / "in/day=*"), schema, 1 if one_by_one else None), "ts", delay)


def test_batches_give_what_one_batch_gives(spark, folder):
    rows = spark.read.parquet(str(folder / "in"))
    want = {(r["user"], r["window_start"], r["n"], r["mean_value"]) for r in windows.tumbling(rows.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "3 hours", ["user"]).collect()}
    for one_by_one in (True, False):
        got = windows.drain(windows.tumbling(stream(spark, folder, "30 days", one_by_one), "ts", "value", "3 hours", ["user"]), ["user", "window_start"])
        assert {(r["user"], r["window_start"], r["n"], r["mean_value"]) for r in got.collect()} == want and len(want) == 5


def test_closed_windows_are_written_once(spark, folder):
    got = windows.drain(windows.tumbling(stream(spark, folder, "1 hour", False), "ts", "value", "1 hour", ["user"]), [], "append").collect()
    assert {(r["user"], r["window_start"].hour) for r in got} >= {("a", 0), ("b", 0), ("a", 9)} and len(got) == len(set(got))


def test_a_drained_stream_goes_on_where_it_stopped(spark, folder, tmp_path):
    made = lambda: windows.tumbling(stream(spark, folder, "30 days"), "ts", "value", "1 hour", ["user"])
    place = str(tmp_path / "run")
    first = windows.drain(made(), ["user", "window_start"], path=place)
    before = {(r["user"], r["window_start"]): r["n"] for r in first.collect()}
    spark.createDataFrame([("b", at(11, 5), 6.0), ("c", at(12), 1.0)], SCHEMA).coalesce(1).write.parquet(str(folder / "in/day=3"))
    after = {(r["user"], r["window_start"]): r["n"] for r in windows.drain(made(), ["user", "window_start"], path=place).collect()}
    changed = {k[0] for k in after if before.get(k) != after[k]}
    assert len(after) == len(before) + 1 and changed == {"b", "c"}


def test_sessions(spark, folder):
    got = windows.drain(windows.sessions(stream(spark, folder, "30 days"), "ts", "value", "1 hour", ["user"]), [], "complete").collect()
    assert sorted((str(r["user"]), r["n"]) for r in got) == [("None", 1), ("a", 2), ("a", 2), ("b", 1), ("b", 1)]
