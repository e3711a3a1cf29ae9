"""The event table read as a stream and drained, against the same aggregates in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.queries.registry import query, table
from statloom.streaming import windows

DELAY = "3650 days"


def events(spark, sf):
    schema = table(spark, sf, "events").schema
    return windows.watermark(windows.stream_files(spark, f"{sf}/events.parquet*", schema), "ts", DELAY)


def plain_times(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in df.columns if c.startswith("window_")})


MEASURES = "count(*) AS n, avg(value) AS mean_value, min(value) AS min_value, max(value) AS max_value"


@query(f"SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS window_start, {MEASURES} FROM events GROUP BY ALL")
def q_stream_tumbling(spark, sf):
    """Six-hour windows per event type."""
    return plain_times(windows.drain(windows.tumbling(events(spark, sf), "ts", "value", "6 hours", ["event_type"]), ["event_type", "window_start"]))


@query(f"""
WITH e AS (SELECT *, unnest([time_bucket(INTERVAL 6 HOURS, ts), time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS]) AS window_start FROM events)
SELECT event_type, window_start, {MEASURES} FROM e GROUP BY ALL
""")
def q_stream_sliding(spark, sf):
    """Twelve-hour windows every six hours."""
    made = windows.tumbling(events(spark, sf), "ts", "value", "12 hours", ["event_type"], "6 hours")
    return plain_times(windows.drain(made, ["event_type", "window_start"]))


@query(f"""
WITH e AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 12 HOURS, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 12 HOURS AS window_end, {MEASURES} FROM s GROUP BY user_id, session
""")
def q_stream_sessions(spark, sf):
    """Sessions of each user, closed by twelve quiet hours."""
    made = windows.sessions(events(spark, sf), "ts", "value", "12 hours", ["user_id"])
    return plain_times(windows.drain(made, ["user_id", "window_start"], "complete"))
