"""Bins, densities, cells and residuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import charts, series
from statloom.queries.registry import long_sql, query, table

PRICE = ["l_quantity", "l_extendedprice"]
LO, HI, CELLS = 2.0, 7.5, 79
LOG = "SELECT strftime(ts, '%Y-%m-%d') AS day, ln(1 + value) AS x FROM events"


def histogram_sql(long: str, keys: str, bins: int) -> str:
    return f"""
WITH long AS ({long}),
s AS (SELECT {keys}, min(value) AS lo, max(value) AS hi FROM long GROUP BY {keys}),
c AS (SELECT {keys}, CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / {bins})), {bins - 1}) ELSE 0 END::INTEGER AS bin,
             count(*) AS count FROM long JOIN s USING ({keys}) GROUP BY ALL),
spine AS (SELECT *, unnest(range({bins}))::INTEGER AS bin FROM s)
SELECT {keys}, bin, lo + (hi - lo) / {bins} * (bin + 0.5::DOUBLE) AS midpoint, coalesce(count, 0) AS count
FROM spine LEFT JOIN c USING ({keys}, bin)
"""


@query(histogram_sql(long_sql("lineitem", PRICE), "variable", 25))
def q_histogram(spark, sf):
    return charts.histogram(table(spark, sf, "lineitem"), PRICE, 25)


@query("""
WITH c AS (SELECT least(floor(value / 5::DOUBLE), 9)::INTEGER AS bin, count(*) AS count FROM events WHERE value BETWEEN 0 AND 50 GROUP BY 1)
SELECT b::INTEGER AS bin, (b + 0.5::DOUBLE) * 5 AS midpoint, coalesce(count, 0) AS count FROM range(10) r(b) LEFT JOIN c ON bin = b
""")
def q_histogram_fixed(spark, sf):
    return charts.histogram_fixed(table(spark, sf, "events"), "value", 0.0, 50.0, 10)


@query(histogram_sql("""
SELECT 'all' AS panel, 'l_extendedprice' AS variable, l_extendedprice AS value FROM lineitem
UNION ALL SELECT 'group ' || l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem
WHERE l_returnflag IN (SELECT DISTINCT l_returnflag FROM lineitem ORDER BY 1 LIMIT 2)
""", "panel, variable", 25))
def q_histogram_by_group(spark, sf):
    return charts.histogram_whole_and_groups(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", 25)


DENSITY = f"""
t AS ({LOG}), w AS (SELECT ({HI}::DOUBLE - {LO}::DOUBLE) / {CELLS} AS w),
big AS (SELECT day FROM t GROUP BY day HAVING count(x) >= 2),
c AS (SELECT day, least(floor((x - {LO}::DOUBLE) / w), {CELLS - 1})::INTEGER AS bin, count(*) AS c FROM t, w
      WHERE x BETWEEN {LO}::DOUBLE AND {HI}::DOUBLE GROUP BY ALL),
spine AS (SELECT day, unnest(range({CELLS}))::INTEGER AS bin FROM (SELECT DISTINCT day FROM c) JOIN big USING (day)),
d AS (SELECT day, bin, {LO}::DOUBLE + w * (bin + 0.5::DOUBLE) AS midpoint,
             coalesce(c, 0) / (sum(c) OVER (PARTITION BY day)::DOUBLE * w) AS d FROM spine LEFT JOIN c USING (day, bin), w)
"""


@query(f"WITH {DENSITY} SELECT day, bin, midpoint, d AS density FROM d")
def q_density_by_group(spark, sf):
    return charts.density_by_group(log_values(spark, sf), "x", "day", LO, HI, CELLS)


@query(f"""
WITH {DENSITY},
k AS (SELECT day, bin, midpoint, (coalesce(lag(d, 2) OVER w, 0) + 2 * coalesce(lag(d, 1) OVER w, 0) + 3 * d
             + 2 * coalesce(lead(d, 1) OVER w, 0) + coalesce(lead(d, 2) OVER w, 0)) / 9 AS s
      FROM d WINDOW w AS (PARTITION BY day ORDER BY bin))
SELECT day, bin, midpoint, coalesce(s / nullif(max(s) OVER (PARTITION BY day), 0) * 0.85::DOUBLE, s) AS density FROM k
""")
def q_ridgeline(spark, sf):
    return charts.density_by_group(log_values(spark, sf), "x", "day", LO, HI, CELLS, smooth=True)


def log_values(spark, sf):
    return table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.log1p("value").alias("x")
    )


@query(f"""
WITH long AS ({long_sql("lineitem", PRICE)}),
s AS (SELECT variable, min(value) AS lo, max(value) AS hi, stddev_samp(value) * pow(count(*), -0.2::DOUBLE) AS bw, count(*) AS n
      FROM long GROUP BY variable),
h AS (SELECT variable, least(floor((value - lo) / ((hi - lo) / 200)), 199) AS bin, count(*) AS c FROM long JOIN s USING (variable) GROUP BY ALL),
g AS (SELECT *, unnest(range(50))::INTEGER AS point FROM s)
SELECT variable, point, any_value(lo + (hi - lo) * point / 49) AS x,
       sum(c * exp(-0.5::DOUBLE * pow((lo + (hi - lo) * point / 49 - (lo + (hi - lo) / 200 * (bin + 0.5::DOUBLE))) / bw, 2)))
         / any_value(n * bw * sqrt(2 * pi())) AS density
FROM g JOIN h USING (variable) GROUP BY variable, point
""")
def q_kde(spark, sf):
    return charts.kde(table(spark, sf, "lineitem"), PRICE)


@query("""
WITH p AS (SELECT (l_quantity * sqrt(3) / 3 - l_extendedprice / 2000 / 3) / 2 AS q, l_extendedprice / 2000 * (2 / 3::DOUBLE) / 2 AS r FROM lineitem),
k AS (SELECT q, r, -q - r AS s, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs FROM p),
d AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM k)
SELECT (CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END)::INTEGER AS cell_q,
       (CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END)::INTEGER AS cell_r, count(*) AS count FROM d GROUP BY 1, 2
""")
def q_hexbin(spark, sf):
    return charts.hexbin(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 2.0, 1.0, 2000.0)


@query("""
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour_start, avg(value) AS value FROM events GROUP BY ALL),
l AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY hour_start) AS p FROM h)
SELECT event_type, hour_start, value AS actual, p AS predicted, value - p AS residual FROM l WHERE p IS NOT NULL
""")
def q_residuals(spark, sf):
    return charts.residuals(persistence(spark, sf), "actual", "predicted")


@query(histogram_sql("""
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour_start, avg(value) AS value FROM events GROUP BY ALL),
l AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY hour_start) AS p FROM h)
SELECT event_type, 'residual' AS variable, value - p AS value FROM l WHERE p IS NOT NULL
""", "event_type, variable", 30))
def q_residual_histogram(spark, sf):
    return charts.residual_histogram(persistence(spark, sf), "actual", "predicted", 30, ["event_type"])


def persistence(spark, sf):
    """Hourly means per event type, forecast by the hour before."""
    hours = series.hourly(table(spark, sf, "events"), "ts", ["value"], ["event_type"])
    def last(w, _):
        return {"predicted": F.lag("value", 1).over(w)}
    rows = series.over_rows(hours, ["hour_start"], last, ["event_type"], lookback=1)
    return rows.withColumnRenamed("value", "actual").dropna(subset=["predicted"])
