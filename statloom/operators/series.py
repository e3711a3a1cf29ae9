"""Operators that depend on the order of rows: lags, rolling statistics, gap filling, resampling.

A group that fits one task uses a plain window. A larger one, whether a hot
entity or a whole unkeyed series, is cut into equal blocks of consecutive rows;
each block receives the rows just before it, or the nearest known values on
either side, so that every block can be worked on alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from statloom.operators.selection import nth, order_statistics
from statloom.runtime import fixed

ROWS_PER_TASK = 2_000_000
"""Largest ordered group handed to a single task."""


def _window(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def _fits(df: DataFrame, by: Sequence[str], rows_per_task: int) -> bool:
    if not by:
        return df.count() <= rows_per_task
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return (sizes.agg(F.max("n")).first()[0] or 0) <= rows_per_task


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also pairs missing keys; the right side's key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def number_rows(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``_pos``, the 1-based place of each row in its group, by a distributed sort.

    ``order`` must identify a row within its group. Range partitions may split a
    group anywhere; the rows before each piece are added from a table with one
    entry per piece.
    """
    by, order = list(by), list(order)
    pieces = df.repartitionByRange(*by, *order).withColumn("_chunk", F.spark_partition_id())
    pieces = fixed(pieces)
    keys = [*by, "_chunk"]
    sizes = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    earlier = _window(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    within = pieces.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    placed = _match(within, starts, keys)
    return placed.withColumn("_pos", F.col("_rn") + F.col("_start")).drop("_rn", "_start", "_chunk")


def over_rows(
    df: DataFrame,
    order: Sequence[str],
    columns: Callable[[WindowSpec, Column], dict[str, Column] | Column],
    by: Sequence[str] = (),
    lookback: int = 0,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add window columns that look at most ``lookback`` rows back.

    ``columns`` receives the ordered window and the number of group rows that
    precede it, and returns the columns to add (a single one is named ``code``).
    """
    limit = rows_per_task or ROWS_PER_TASK

    def build(w: WindowSpec, start: Column) -> dict[str, Column]:
        made = columns(w, start)
        return made if isinstance(made, dict) else {"code": made}

    if _fits(df, by, limit):
        return df.withColumns(build(_window(by).orderBy(*order), F.lit(0)))
    size = max(limit, lookback)
    placed = number_rows(df, order, by)
    home = F.floor((F.col("_pos") - 1) / F.lit(size))
    placed = placed.withColumn("_home", home)
    if lookback:
        tail = (F.col("_pos") - 1) % F.lit(size) >= size - lookback
        blocks = F.when(tail, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
        placed = placed.withColumn("_block", F.explode(blocks))
    else:
        placed = placed.withColumn("_block", F.col("_home"))
    w = Window.partitionBy(*by, "_block").orderBy("_pos")
    start = F.when(F.col("_block") > 0, F.col("_block") * size - lookback).otherwise(0)
    out = placed.withColumns(build(w, start)).where(F.col("_block") == F.col("_home"))
    return out.drop("_pos", "_home", "_block")


def fill_gaps(
    df: DataFrame,
    cols: Sequence[str],
    order: Sequence[str],
    by: Sequence[str] = (),
    method: str = "interpolate",
    rows_per_task: int | None = None,
) -> DataFrame:
    """Fill missing values from neighbouring rows of the same group.

    ``ffill`` takes the last known value, ``bfill`` the next one, and
    ``interpolate`` draws a straight line by row position between both, repeating
    the nearest known value at the ends.
    """
    if method not in ("ffill", "bfill", "interpolate"):
        raise ValueError(f"unknown method {method}")
    limit = rows_per_task or ROWS_PER_TASK
    by = list(by)
    one_block = _fits(df, by, limit)
    if one_block:
        placed = df.withColumn("_pos", F.row_number().over(_window(by).orderBy(*order))).withColumn("_block", F.lit(0))
    else:
        placed = number_rows(df, order, by).withColumn("_block", F.floor((F.col("_pos") - 1) / F.lit(limit)))
    keys = [*by, "_block"]
    # Looking ahead is done by running backwards: a frame that only grows is linear,
    # one that shrinks towards the end is recomputed for every row.
    back = Window.partitionBy(*keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, 0)
    near = {}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.col("_pos"))
        near[f"_pv_{c}"] = F.last(c, ignorenulls=True).over(back)
        near[f"_pp_{c}"] = F.last(at, ignorenulls=True).over(back)
        near[f"_nv_{c}"] = F.last(c, ignorenulls=True).over(ahead)
        near[f"_np_{c}"] = F.last(at, ignorenulls=True).over(ahead)
    if not one_block:
        ends = []
        for c in cols:
            at = F.when(F.col(c).isNotNull(), F.col("_pos"))
            ends += [
                F.max_by(c, at).alias(f"_pv_{c}"),
                F.max(at).alias(f"_pp_{c}"),
                F.min_by(c, at).alias(f"_nv_{c}"),
                F.min(at).alias(f"_np_{c}"),
            ]
        before = _window(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        after = _window(by).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
        summary = placed.groupBy(*keys).agg(*ends)
        carried = summary.select(
            *keys,
            *[F.last(f"{p}{c}", ignorenulls=True).over(before).alias(f"_c{p}{c}") for c in cols for p in ("_pv_", "_pp_")],
            *[F.last(f"{p}{c}", ignorenulls=True).over(after).alias(f"_c{p}{c}") for c in cols for p in ("_nv_", "_np_")],
        )
        placed = _match(placed.withColumns(near), carried, keys)
        placed = placed.withColumns({name: F.coalesce(name, f"_c{name}") for name in near})
    else:
        placed = placed.withColumns(near)
    filled = {}
    for c in cols:
        pv, pp, nv, np_ = (F.col(f"{p}{c}") for p in ("_pv_", "_pp_", "_nv_", "_np_"))
        line = pv + (nv - pv) * (F.col("_pos") - pp) / F.nullif(np_ - pp, F.lit(0))
        filled[c] = {
            "ffill": F.coalesce(F.col(c), pv),
            "bfill": F.coalesce(F.col(c), nv),
            "interpolate": F.coalesce(F.col(c), line, pv, nv),
        }[method]
    return placed.withColumns(filled).select(*df.columns)


def diff(df: DataFrame, col: str, order: Sequence[str], by: Sequence[str] = (), **kw) -> DataFrame:
    """Change since the previous row; missing on the first."""
    name = f"{col}_diff"
    return over_rows(df, order, lambda w, _: {name: F.col(col) - F.lag(col, 1).over(w)}, by, lookback=1, **kw)


def rolling(
    df: DataFrame,
    col: str,
    order: Sequence[str],
    rows: int,
    by: Sequence[str] = (),
    include_current: bool = True,
    std: bool = False,
    **kw,
) -> DataFrame:
    """Mean (and deviation) of a full run of rows ending at, or just before, the current row."""
    first, last = (1 - rows, 0) if include_current else (-rows, -1)
    def made(w: WindowSpec, _: Column) -> dict[str, Column]:
        frame = w.rowsBetween(first, last)
        full = F.count(col).over(frame) == rows
        out = {f"rolling_mean_{rows}": F.when(full, F.avg(col).over(frame))}
        if std:
            out[f"rolling_std_{rows}"] = F.when(full, F.stddev_samp(col).over(frame))
        return out
    return over_rows(df, order, made, by, lookback=rows, **kw)


def lag_features(
    df: DataFrame, col: str, order: Sequence[str], lags: Sequence[int], rolling_rows: int, by: Sequence[str] = (), **kw
) -> DataFrame:
    """Values k rows earlier and the mean of the rows before the current one, in one window."""
    def made(w: WindowSpec, _: Column) -> dict[str, Column]:
        frame = w.rowsBetween(-rolling_rows, -1)
        out = {f"lag_{k}": F.lag(col, k).over(w) for k in lags}
        mean = F.when(F.count(col).over(frame) == rolling_rows, F.avg(col).over(frame))
        return out | {f"rolling_mean_{rolling_rows}": mean}
    return over_rows(df, order, made, by, lookback=max(*lags, rolling_rows), **kw)


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """Hour, weekday (Monday 0), weekend flag and month key."""
    day = F.weekday(ts)
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "dayofweek": day,
            "is_weekend": (day >= 5).cast("int"),
            "month": F.date_format(ts, "yyyy-MM"),
        }
    )


def daily_aggregate(df: DataFrame, ts: str, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, mean of log1p and rows per day that has rows."""
    return df.groupBy(*by, F.to_date(ts).alias("day")).agg(
        F.avg(col).alias("mean_value"),
        F.stddev_samp(col).alias("std_value"),
        F.avg(F.log1p(col)).alias("mean_log1p"),
        F.count(col).alias("n"),
    )


def daily_mean(df: DataFrame, ts: str, col: str) -> DataFrame:
    """Mean per calendar day from the first to the last one; days without rows are missing."""
    days = df.groupBy(F.to_date(ts).alias("day")).agg(F.avg(col).alias("mean_value"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(days, "day", "left")


def hourly(df: DataFrame, ts: str, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Hourly means of numeric columns; hours with any missing mean are dropped."""
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour_start")
    means = df.groupBy(*by, hour).agg(*[F.avg(c).alias(c) for c in cols])
    return means.dropna(subset=list(cols))


def sliding_features(
    df: DataFrame, ts: str, col: str, width: str, step: str, by: Sequence[str] = ()
) -> DataFrame:
    """Mean, variance, root mean square and energy per sliding window."""
    x = F.col(col)
    return (
        df.groupBy(*by, F.window(ts, width, step).alias("w"))
        .agg(
            F.count(col).alias("n"),
            F.avg(x).alias("mean"),
            F.var_samp(x).alias("variance"),
            F.sqrt(F.avg(x * x)).alias("rms"),
            F.sum(x * x).alias("energy"),
        )
        .select(*by, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "mean", "variance", "rms", "energy")
    )


def time_info(df: DataFrame, ts: str, key: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """Start, end, rows and the most frequent step in minutes, smallest on ties."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    times = df.where(F.col(ts).isNotNull()).select(*by, ts, key, micros.alias("_us"))
    def made(w: WindowSpec, _: Column) -> dict[str, Column]:
        return {"_step": F.col("_us") - F.lag("_us", 1).over(w)}
    steps = over_rows(times, [ts, key], made, by, lookback=1, **kw)
    counts = steps.groupBy(*by, "_step").agg(
        F.count(F.lit(1)).alias("_c"), F.min(ts).alias("start"), F.max(ts).alias("end")
    )
    common = F.min(F.when(F.col("_step").isNotNull(), F.struct((-F.col("_c")).alias("c"), "_step")))
    return counts.groupBy(*by).agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("_c").alias("samples"),
        (common.getField("_step") / F.lit(60e6)).alias("frequency_minutes_mode"),
    )


def first_days(df: DataFrame, ts: str, days: int = 7) -> DataFrame:
    """Rows up to ``days`` after the first timestamp; the bound reaches the scan as a filter."""
    first = df.agg(F.min(ts)).first()[0]
    return df.where(F.col(ts) <= F.lit(first).cast(df.schema[ts].dataType) + F.expr(f"INTERVAL {int(days)} DAYS"))


def time_split(df: DataFrame, ts: str, key: str, share: float = 0.8) -> DataFrame:
    """Mark the first floor(share n) rows in order of (ts, key) as ``train``, the rest as ``test``.

    The cut is found as an order statistic, so nothing is sorted; ``key`` is a
    numeric row key that decides among rows with the same time.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
    n = df.where(F.col(ts).isNotNull()).count()
    k = int(share * n)
    if k == 0:
        return df.withColumn("split", F.lit("test"))

    def smallest(rows: DataFrame, value: Column, place: int) -> float:
        shaped = rows.select(F.lit("v").alias("variable"), value.alias("value"))
        return order_statistics(shaped, ["variable"], [nth(place)]).first()["q"][0]

    # Whole keys are compared in two parts that doubles hold exactly.
    parts = [F.col(key).cast("double")]
    if df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte"):
        whole = F.col(key).cast("bigint")
        parts = [F.shiftright(whole, 30).cast("double"), whole.bitwiseAND(F.lit((1 << 30) - 1)).cast("double")]
    timed = df.where(F.col(ts).isNotNull())
    train, tied, left = F.lit(False), F.lit(True), k
    for value in [at, *parts]:
        cut = smallest(timed.where(tied), value, left)
        sides = timed.where(tied).agg(F.count(F.when(value < cut, 1)).alias("below"), F.count(F.when(value == cut, 1)).alias("ties")).first()
        train, tied, left = train | (tied & (value < cut)), tied & (value == cut), left - sides["below"]
        if sides["ties"] == left:
            break
    train = train | tied
    return df.withColumn("split", F.when(train, "train").otherwise("test"))
