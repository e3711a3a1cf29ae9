"""ARMA models by the two regressions of Hannan and Rissanen, for every entity at once.

A long autoregression gives residuals; the value is then regressed on its own lags and on lagged residuals. Both
regressions are grouped moments (one aggregate, so a hot entity is summed where its rows are) and a system of a few
equations that column expressions solve. Rows of a long series are cut into blocks by ``over_rows``; no entity meets in
one task. Rows with a missing value or lag leave a regression, an entity whose equations are singular gets no
coefficients.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators.series import _match, over_rows
from statloom.runtime import fixed, settle


def regress(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, n, intercept, b1 .. bk): least squares of ``y`` on ``xs`` with a constant, per group.

    The centred normal equations are eliminated step by step, each step one projection.
    """
    size = len(xs)
    full = F.lit(True)
    for c in (y, *xs):
        full = full & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    value = {c: F.when(full, F.col(c).cast("double")) for c in (y, *xs)}
    moments = {"n": F.count(value[y]), "my": F.avg(value[y])}
    for i, x in enumerate(xs):
        moments[f"m{i}"], moments[f"r{i}"] = F.avg(value[x]), F.covar_pop(value[x], value[y])
        moments |= {f"a{i}_{j}": F.covar_pop(value[x], value[xs[j]]) for j in range(i, size)}
    table = df.groupBy(*by).agg(*[m.alias(c) for c, m in moments.items()])
    for k in range(size - 1):
        pivot = F.nullif(F.col(f"a{k}_{k}"), F.lit(0.0))
        step = {}
        for i in range(k + 1, size):
            factor = F.col(f"a{k}_{i}") / pivot
            step |= {f"a{i}_{j}": F.col(f"a{i}_{j}") - factor * F.col(f"a{k}_{j}") for j in range(i, size)}
            step[f"r{i}"] = F.col(f"r{i}") - factor * F.col(f"r{k}")
        table = table.withColumns(step)
    for i in reversed(range(size)):
        known = sum((F.col(f"a{i}_{j}") * F.col(f"b{j + 1}") for j in range(i + 1, size)), F.lit(0.0))
        table = table.withColumn(f"b{i + 1}", (F.col(f"r{i}") - known) / F.nullif(F.col(f"a{i}_{i}"), F.lit(0.0)))
    mean = sum((F.col(f"b{i + 1}") * F.col(f"m{i}") for i in range(size)), F.lit(0.0))
    return table.select(*by, "n", (F.col("my") - mean).alias("intercept"), *[f"b{i + 1}" for i in range(size)])


def residuals(df: DataFrame, col: str, order: Sequence[str], by: Sequence[str], lags: int) -> DataFrame:
    """(by, order, value, lagged values y1 .. y<lags>, e): rows with the residual of an autoregression of each entity."""
    names = [f"y{i}" for i in range(1, lags + 1)]
    rows = df.select(*by, *order, F.col(col).cast("double").alias("value"))
    rows = over_rows(rows, order, lambda w, _: {f"y{i}": F.lag("value", i).over(w) for i in range(1, lags + 1)}, by, lookback=lags)
    fit = settle(regress(rows, "value", names, by).drop("n"))
    rows = _match(rows, fit, by)
    fitted = sum((F.col(f"b{i}") * F.col(f"y{i}") for i in range(1, lags + 1)), F.col("intercept"))
    return rows.select(*by, *order, "value", *names, (F.col("value") - fitted).alias("e"))


def fit(df: DataFrame, col: str, order: Sequence[str], by: Sequence[str] = (), p: int = 2, q: int = 2, long_order: int = 6) -> DataFrame:
    """(by, n, intercept, ar1 .. arp, ma1 .. maq, y_last, e_last) of each entity.

    ``y_last`` and ``e_last`` are the last values and residuals, newest first, from which a forecast starts; a missing residual counts as 0.
    """
    by = list(by)
    if not by:
        return fit(df.withColumn("_all", F.lit(1)), col, order, ["_all"], p, q, long_order).drop("_all")
    rows = residuals(df, col, order, by, max(long_order, p))
    ys, es = [f"y{i}" for i in range(1, p + 1)], [f"e{i}" for i in range(1, q + 1)]
    rows = rows.select(*by, *order, "value", "e", *[f"y{i}" for i in range(1, max(long_order, p) + 1)])
    rows = over_rows(rows, order, lambda w, _: {f"e{i}": F.lag("e", i).over(w) for i in range(1, q + 1)}, by, lookback=q)
    rows = fixed(rows)
    model = regress(rows, "value", [*ys, *es], by)
    names = {f"b{i + 1}": (f"ar{i + 1}" if i < p else f"ma{i + 1 - p}") for i in range(p + q)}
    newest = lambda first, more: F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in [first, *more][: len(more)]])
    last = F.max(F.struct(*order, newest("value", ys).alias("ys"), newest("e", es).alias("es"))).alias("last")
    ends = settle(rows.where(F.col("value").isNotNull()).groupBy(*by).agg(last))
    model = model.withColumnsRenamed(names)
    model = _match(model, ends, by)
    return model.select(*by, "n", "intercept", *names.values(), F.col("last.ys").alias("y_last"), F.col("last.es").alias("e_last"))


def forecast(model: DataFrame, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, step, forecast): one-step forecasts repeated ``steps`` times, later shocks being 0."""
    ar = sorted((c for c in model.columns if c.startswith("ar") and c[2:].isdigit()), key=lambda c: int(c[2:]))
    ma = sorted((c for c in model.columns if c.startswith("ma") and c[2:].isdigit()), key=lambda c: int(c[2:]))
    start = F.struct(F.col("y_last").alias("ys"), F.col("e_last").alias("es"), F.array().cast("array<double>").alias("path"))

    def step(s: Column, _: Column) -> Column:
        y = F.col("intercept")
        for i, c in enumerate(ar):
            y = y + F.col(c) * F.get(s["ys"], F.lit(i))
        for i, c in enumerate(ma):
            y = y + F.col(c) * F.get(s["es"], F.lit(i))
        shift = lambda new, old: F.slice(F.concat(F.array(new), old), F.lit(1), F.size(old))
        return F.struct(shift(y, s["ys"]).alias("ys"), shift(F.lit(0.0), s["es"]).alias("es"), F.concat(s["path"], F.array(y)).alias("path"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["path"])
    return model.select(*by, F.posexplode(path).alias("i", "forecast")).select(*by, (F.col("i") + 1).alias("step"), "forecast")


def held_out(df: DataFrame, col: str, order: Sequence[str], split: str = "split", **orders) -> DataFrame:
    """(order, actual, predicted, model) of the test rows of one series, forecast from its training rows alone."""
    df = fixed(df)
    model = fit(df.where(F.col(split) == "train"), col, order, **orders)
    test = over_rows(df.where(F.col(split) == "test").select(*order, col), order, lambda w, before: {"step": (F.row_number().over(w) + before).cast("int")})
    ahead = forecast(model, max(test.count(), 1))
    return test.join(ahead, "step").select(*order, F.col(col).cast("double").alias("actual"), F.col("forecast").alias("predicted"), F.lit("arma").alias("model"))
