"""Operators over time: calendar, lags, rolling statistics, gap filling, resampling, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions.scalars import day_or_night
from statloom.operators import series
from statloom.operators.sampling import head_per_group
from statloom.queries.registry import holed, holed_sql, query, table

HOURLY = "SELECT event_type, date_trunc('hour', ts) AS hour_start, avg(value) AS value FROM events GROUP BY ALL"
HOLED = holed_sql("events", ["event_id", "user_id", "ts"], {"value": 7}, "event_id")


def events(spark, sf):
    return table(spark, sf, "events")


def holed_events(spark, sf):
    rows = events(spark, sf).select("event_id", "user_id", "ts", "value")
    return holed(rows, {"value": 7}, "event_id")


@query(f"""
WITH h AS ({HOURLY}),
w AS (SELECT *, lag(value, 1) OVER o AS lag_1, lag(value, 24) OVER o AS lag_24,
             avg(value) OVER (o ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS m,
             count(value) OVER (o ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS c
      FROM h WINDOW o AS (PARTITION BY event_type ORDER BY hour_start))
SELECT event_type, hour_start, value, lag_1, lag_24, m AS rolling_mean_24 FROM w WHERE lag_24 IS NOT NULL AND c = 24
""")
def q_lag_features(spark, sf):
    hours = series.hourly(events(spark, sf), "ts", ["value"], ["event_type"])
    lagged = series.lag_features(hours, "value", ["hour_start"], [1, 24], 24, ["event_type"])
    return lagged.dropna()


@query("""
SELECT event_id, CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END AS rolling_mean_3 FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""")
def q_rolling_mean(spark, sf):
    rows = events(spark, sf).select("event_id", "user_id", "ts", "value")
    return series.rolling(rows, "value", ["ts", "event_id"], 3, ["user_id"]).select("event_id", "rolling_mean_3")


@query(f"""
WITH h AS (SELECT date_trunc('hour', ts) AS hour_start, avg(value) AS value FROM events GROUP BY ALL)
SELECT hour_start, value, CASE WHEN count(value) OVER w = 24 THEN avg(value) OVER w END AS rolling_mean_24,
       CASE WHEN count(value) OVER w = 24 THEN stddev_samp(value) OVER w END AS rolling_std_24
FROM h WINDOW w AS (ORDER BY hour_start ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)
""")
def q_rolling_std(spark, sf):
    hours = series.hourly(events(spark, sf), "ts", ["value"])
    return series.rolling(hours, "value", ["hour_start"], 24, std=True)


@query("""
SELECT event_id, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS dayofweek,
       CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, strftime(ts, '%Y-%m') AS month FROM events
""")
def q_calendar_features(spark, sf):
    return series.calendar(events(spark, sf).select("event_id", "ts"), "ts").drop("ts")


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, avg(o_totalprice) AS mean_price FROM orders GROUP BY month
""")
def q_monthly(spark, sf):
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    return table(spark, sf, "orders").groupBy(month).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price")
    )


@query("SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month FROM lineitem ORDER BY month")
def q_distinct_months(spark, sf):
    return table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month")).distinct().orderBy("month")


@query("""
SELECT event_type, ts::DATE AS day, avg(value) AS mean_value, stddev_samp(value) AS std_value,
       avg(ln(1 + value)) AS mean_log1p, count(value) AS n FROM events GROUP BY ALL
""")
def q_daily_agg(spark, sf):
    return series.daily_aggregate(events(spark, sf), "ts", "value", ["event_type"])


@query("""
WITH s AS (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY))::DATE AS day FROM orders)
SELECT day, avg(o_totalprice) AS mean_value FROM s LEFT JOIN orders ON o_orderdate::DATE = day GROUP BY day
""")
def q_daily_mean(spark, sf):
    return series.daily_mean(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


@query(f"SELECT * FROM ({HOURLY}) WHERE value IS NOT NULL")
def q_hourly_resample(spark, sf):
    return series.hourly(events(spark, sf), "ts", ["value"], ["event_type"])


@query("""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN i <= floor(0.8::DOUBLE * n) THEN 'train' ELSE 'test' END AS split FROM r
""")
def q_time_split(spark, sf):
    return series.time_split(events(spark, sf).select("event_id", "ts"), "ts", "event_id").select("event_id", "split")


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN i <= floor(0.8::DOUBLE * n) THEN 'train' ELSE 'test' END AS split FROM r
""")
def q_time_split_ties(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return series.time_split(orders, "o_orderdate", "o_orderkey").select("o_orderkey", "split")


@query("""
SELECT CASE WHEN hour(ts) >= 6 AND hour(ts) < 18 THEN 0 ELSE 1 END AS night, count(*) AS n, avg(value) AS mean,
       stddev_samp(value) AS std FROM events GROUP BY night
""")
def q_day_night_stats(spark, sf):
    return (
        events(spark, sf)
        .groupBy(day_or_night(F.col("ts")).alias("night"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    )


@query("""
WITH w AS (SELECT event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS window_start
           FROM events)
SELECT event_type, window_start, count(value) AS n, avg(value) AS mean, var_samp(value) AS variance,
       sqrt(avg(value * value)) AS rms, sum(value * value) AS energy FROM w GROUP BY ALL
""")
def q_sliding_features(spark, sf):
    return series.sliding_features(events(spark, sf), "ts", "value", "2 hours", "1 hour", ["event_type"])


@query("""
WITH d AS (SELECT event_type, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS s FROM events),
m AS (SELECT event_type, s, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, s) AS rn
      FROM d WHERE s IS NOT NULL GROUP BY event_type, s)
SELECT event_type, min(ts) AS start, max(ts) AS end, count(*) AS samples, any_value(m.s) / 60e6 AS frequency_minutes_mode
FROM d JOIN m USING (event_type) WHERE m.rn = 1 GROUP BY event_type
""")
def q_time_info(spark, sf):
    return series.time_info(events(spark, sf), "ts", "event_id", ["event_type"])


@query("""
SELECT event_id, ts, value FROM events WHERE ts <= (SELECT min(ts) FROM events) + INTERVAL 7 DAY
""")
def q_first_week(spark, sf):
    return series.first_days(events(spark, sf).select("event_id", "ts", "value"), "ts", 7)


@query("""
SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_diff FROM events
""")
def q_diff(spark, sf):
    rows = events(spark, sf).select("event_id", "user_id", "ts", "value")
    return series.diff(rows, "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value_diff")


@query(f"""
WITH t AS ({HOLED}), n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i FROM t),
b AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS pv,
             last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi,
             first_value(value IGNORE NULLS) OVER f AS nv,
             first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni
      FROM n WINDOW p AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    f AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, coalesce(value, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0)::DOUBLE, pv, nv) AS value FROM b
""")
def q_interpolate(spark, sf):
    filled = series.fill_gaps(holed_events(spark, sf), ["value"], ["ts", "event_id"])
    return filled.select("event_id", "value")


@query(f"""
WITH t AS ({HOLED}),
f AS (SELECT event_id, user_id, ts, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS value FROM t)
SELECT event_id, coalesce(value, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM f
""")
def q_ffill_bfill(spark, sf):
    forward = series.fill_gaps(holed_events(spark, sf), ["value"], ["ts", "event_id"], ["user_id"], "ffill")
    return series.fill_gaps(forward, ["value"], ["ts", "event_id"], ["user_id"], "bfill").select("event_id", "value")


@query("""
SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3
""")
def q_head_per_group(spark, sf):
    return head_per_group(events(spark, sf).select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 3)
