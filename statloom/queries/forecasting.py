"""ARMA models of the hourly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.learning import arma, metrics
from statloom.operators import series
from statloom.queries.registry import query, table

LONG = 6


def regression_sql(name: str, source: str, xs: list[str], by: str, tail: str) -> str:
    """CTEs that end in ``name``: least squares of y on xs by elimination, ``tail`` naming the coefficients."""
    size = len(xs)
    where = " AND ".join(f"{c} IS NOT NULL" for c in ("y", *xs))
    parts = [f"avg({x}) AS m{i}, covar_pop({x}, y) AS r{i}" for i, x in enumerate(xs)]
    parts += [f"covar_pop({xs[i]}, {xs[j]}) AS a{i}_{j}" for i in range(size) for j in range(i, size)]
    steps = [f"{name}_0 AS (SELECT {by}, count(*) AS n, avg(y) AS my, {', '.join(parts)} FROM {source} WHERE {where} GROUP BY {by})"]
    for k in range(size - 1):
        new = [f"a{i}_{j} - a{k}_{i} / a{k}_{k} * a{k}_{j} AS a{i}_{j}" for i in range(k + 1, size) for j in range(i, size)]
        new += [f"r{i} - a{k}_{i} / a{k}_{k} * r{k} AS r{i}" for i in range(k + 1, size)]
        steps.append(f"{name}_{k + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM {name}_{k})")
    last = f"{name}_{size - 1}"
    for i in reversed(range(size)):
        known = "".join(f" - a{i}_{j} * b{j + 1}" for j in range(i + 1, size))
        steps.append(f"{name}_b{i} AS (SELECT *, (r{i}{known}) / a{i}_{i} AS b{i + 1} FROM {last})")
        last = f"{name}_b{i}"
    mean = "".join(f" - b{i + 1} * m{i}" for i in range(size))
    return ",\n".join([*steps, f"{name} AS (SELECT {by}, n, my{mean} AS intercept, {tail} FROM {last})"])


def arma_sql(hours: str, by: str) -> str:
    """CTEs h (by, t, y), the residuals and ``fit`` of an ARMA(2, 2) model with a long autoregression before it."""
    ys = [f"y{i}" for i in range(1, LONG + 1)]
    lags = ", ".join(f"lag(y, {i}) OVER w AS y{i}" for i in range(1, LONG + 1))
    first = regression_sql("ar", "l", ys, by, ", ".join(f"b{i}" for i in range(1, LONG + 1)))
    second = regression_sql("fit", "s", ["y1", "y2", "e1", "e2"], by, "b1 AS ar1, b2 AS ar2, b3 AS ma1, b4 AS ma2")
    fitted = " + ".join(f"b{i} * y{i}" for i in range(1, LONG + 1))
    return f"""h AS ({hours}), l AS (SELECT *, {lags} FROM h WINDOW w AS (PARTITION BY {by} ORDER BY t)),
{first},
e AS (SELECT {by}, t, y, y1, y2, y - (intercept + {fitted}) AS e FROM l JOIN ar USING ({by})),
s AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2 FROM e WINDOW w AS (PARTITION BY {by} ORDER BY t)),
{second},
ends AS (SELECT {by}, arg_max(y, t) AS p1, arg_max(y1, t) AS p2, arg_max(e, t) AS q1, arg_max(e1, t) AS q2 FROM s GROUP BY {by})"""


def path_sql(by: str, steps: str) -> str:
    """CTE f: the forecasts of ``fit`` from ``ends``."""
    return f"""f AS (SELECT {by}, 1 AS step, intercept + ar1 * p1 + ar2 * p2 + ma1 * q1 + ma2 * q2 AS forecast, p1 AS before, q1 AS shock FROM fit JOIN ends USING ({by})
      UNION ALL SELECT {by}, step + 1, intercept + ar1 * forecast + ar2 * before + ma2 * shock, forecast, 0 FROM f JOIN fit USING ({by}) WHERE step < {steps})"""


BY_TYPE = "SELECT event_type, date_trunc('hour', ts) AS t, avg(value) AS y FROM events GROUP BY ALL"


@query(f"WITH {arma_sql(BY_TYPE, 'event_type')} SELECT * FROM fit")
def q_arma_fit(spark, sf):
    """ARMA(2, 2) of each event type's hourly mean."""
    hours = series.hourly(table(spark, sf, "events"), "ts", ["value"], ["event_type"])
    return arma.fit(hours, "value", ["hour_start"], ["event_type"], long_order=LONG).drop("y_last", "e_last")


@query(f"WITH RECURSIVE {arma_sql(BY_TYPE, 'event_type')}, {path_sql('event_type', '24')} SELECT event_type, step, forecast FROM f")
def q_arma_forecast(spark, sf):
    """The next 24 hours of each event type."""
    hours = series.hourly(table(spark, sf, "events"), "ts", ["value"], ["event_type"])
    return arma.forecast(arma.fit(hours, "value", ["hour_start"], ["event_type"], long_order=LONG), 24, ["event_type"])


WHOLE = "SELECT date_trunc('hour', ts) AS t, avg(value) AS y FROM events GROUP BY ALL"
TRAIN = "SELECT 1 AS one, t, y FROM numbered WHERE i <= floor(0.8 * n)"


@query(f"""
WITH RECURSIVE hours AS ({WHOLE}), numbered AS (SELECT *, row_number() OVER (ORDER BY t) AS i, count(*) OVER () AS n FROM hours),
{arma_sql(TRAIN, 'one')}, {path_sql('one', '(SELECT max(n - floor(0.8 * n)) FROM numbered)')},
v AS (SELECT y, forecast AS p FROM f JOIN numbered ON i = floor(0.8 * n) + step)
SELECT 'arma' AS model, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p) / greatest(y, 1)) * 100 AS mape,
       1 - avg((y - p) ** 2) / nullif(var_pop(y), 0) AS r2, stddev_samp(y) AS std_actual, stddev_samp(p) AS std_predicted FROM v
""")
def q_arma_scores(spark, sf):
    """Scores of the last fifth of the hours, forecast from the hours before."""
    hours = series.hourly(table(spark, sf, "events"), "ts", ["value"])
    hours = hours.withColumn("hour_key", F.unix_seconds(F.col("hour_start").cast("timestamp")))
    rows = arma.held_out(series.time_split(hours, "hour_start", "hour_key"), "value", ["hour_start"], long_order=LONG)
    return metrics.regression_metrics(rows, "actual", "predicted", ["model"])
