"""The numbers behind charts: bins, boxes, densities, cells and residuals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.scalars import hex_cell
from statloom.operators.describe import fences
from statloom.operators.selection import long_form
from statloom.runtime import lookup, settle

# Smoothing weights of the ridgeline, and its height.
KERNEL = (1, 2, 3, 2, 1)
RIDGE_HEIGHT = 0.85


def bin_index(value: Column, low: Column, width: Column, bins: int) -> Column:
    """0-based bin of a value; the top edge belongs to the last bin."""
    place = F.when(width > 0, F.floor((value - low) / width)).otherwise(F.lit(0))
    return F.least(place, F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, cols: Sequence[str], bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal bins between each group's own minimum and maximum, empty bins included."""
    keys = [*by, "variable"]
    rows = long_form(df, cols, by)
    limits = settle(
        rows.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    counted = (
        lookup(rows, limits, keys)
        .select(*keys, bin_index(F.col("value"), F.col("lo"), width, bins).alias("bin"))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    spine = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = spine.join(counted, [*keys, "bin"], "left")
    return filled.select(
        *keys,
        "bin",
        (F.col("lo") + width * (F.col("bin") + 0.5)).alias("midpoint"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def histogram_fixed(
    df: DataFrame, col: str, low: float, high: float, bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Bins over given edges; values outside are ignored and the top edge is closed.

    With groups, every group that has a value inside gets all bins.
    """
    by = list(by)
    width = (high - low) / bins
    inside = df.where(F.col(col).between(low, high)).select(*by, F.col(col).cast("double").alias("value"))
    counted = inside.groupBy(*by, bin_index(F.col("value"), F.lit(low), F.lit(width), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    all_bins = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    spine = counted.select(*by).distinct().select(*by, all_bins) if by else df.sparkSession.range(1).select(all_bins)
    return spine.join(counted, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.lit(low) + F.lit(width) * (F.col("bin") + 0.5)).alias("midpoint"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def histogram_whole_and_groups(df: DataFrame, col: str, group: str, bins: int, most: int = 2) -> DataFrame:
    """The whole column and its first ``most`` groups in sorted order, each with its own bins."""
    data = df.select(F.col(group).cast("string").alias("part"), col).dropna()
    first = [r[0] for r in data.select("part").distinct().orderBy("part").limit(most).collect()]
    parts = F.array(F.lit("all"), F.concat(F.lit("group "), F.col("part")))
    chosen = F.when(F.col("part").isin(first), parts).otherwise(F.array(F.lit("all")))
    return histogram(data.select(F.explode(chosen).alias("panel"), col), [col], bins, ["panel"])


def density_by_group(
    df: DataFrame, col: str, group: str, low: float, high: float, bins: int, smooth: bool = False
) -> DataFrame:
    """Density per bin and group; groups with fewer than two values are left out.

    ``smooth`` applies the five-tap kernel, taking bins beyond the ends as zero,
    and scales each group to the same height.
    """
    table = histogram_fixed(df, col, low, high, bins, [group])
    width = (high - low) / bins
    sizes = df.groupBy(group).agg(F.count(col).alias("_all")).where("_all >= 2")
    arrays = (
        table.groupBy(group)
        .agg(F.sort_array(F.collect_list(F.struct("bin", "midpoint", "count"))).alias("b"), F.sum("count").alias("n"))
        .join(sizes, group, "left_semi")
    )
    dens = F.transform("b", lambda x: x["count"] / (F.col("n") * F.lit(width)))
    if smooth:
        reach = len(KERNEL) // 2
        def tap(i: Column, k: int) -> Column:
            return F.coalesce(F.get("d", i + (k - reach)), F.lit(0.0)) * (KERNEL[k] / sum(KERNEL))
        arrays = arrays.withColumn("d", dens)
        spread = F.transform("d", lambda _, i: sum((tap(i, k) for k in range(1, len(KERNEL))), tap(i, 0)))
        arrays = arrays.withColumn("d", spread)
        top = F.nullif(F.array_max("d"), F.lit(0.0))
        arrays = arrays.withColumn("d", F.transform("d", lambda x: F.coalesce(x / top * RIDGE_HEIGHT, x)))
    else:
        arrays = arrays.withColumn("d", dens)
    zipped = F.explode(F.arrays_zip("b", "d")).alias("z")
    return arrays.select(group, zipped).select(
        group,
        F.col("z.b.bin").alias("bin"),
        F.col("z.b.midpoint").alias("midpoint"),
        F.col("z.d").alias("density"),
    )


def box_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, extremes, mean, whisker ends and the number of points beyond them."""
    keys = [*by, "variable"]
    limits = settle(fences(df, cols, by))
    v = F.col("value")
    inside = (v >= F.col("lower")) & (v <= F.col("upper"))
    seen = (
        lookup(long_form(df, cols, by), limits.select(*keys, "lower", "upper"), keys)
        .groupBy(*keys)
        .agg(
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.avg(v).alias("mean"),
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.sum((~inside).cast("bigint")).alias("fliers"),
        )
    )
    return limits.join(seen, keys).select(
        *keys, F.col("n").alias("count"), "min", "q1", "median", "q3", "max", "mean", "whisker_low", "whisker_high", "fliers"
    )


def kde(df: DataFrame, cols: Sequence[str], bins: int = 200, points: int = 50) -> DataFrame:
    """Gaussian density curve over binned values with Scott's bandwidth.

    Only the bin counts (a fixed number per variable) enter the curve, each bin
    weighing in at its midpoint.
    """
    rows = long_form(df, cols)
    spread = rows.groupBy("variable").agg(F.stddev_samp("value").alias("s"), F.count("value").alias("n"))
    held = histogram(df, cols, bins).where("count > 0")
    packed = held.groupBy("variable").agg(
        F.sort_array(F.collect_list(F.struct("midpoint", "count"))).alias("h"),
    )
    limits = rows.groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    table = packed.join(spread, "variable").join(limits, "variable")
    table = table.withColumn("bw", F.col("s") * F.pow(F.col("n"), F.lit(-0.2)))
    grid = table.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1))
    def add(acc: Column, b: Column) -> Column:
        u = (F.col("x") - b["midpoint"]) / F.col("bw")
        return acc + b["count"] * F.exp(u * u * -0.5)
    total = F.aggregate("h", F.lit(0.0), add)
    norm = F.col("n") * F.col("bw") * math.sqrt(2 * math.pi)
    return grid.where("bw > 0").select("variable", "point", "x", (total / norm).alias("density"))


def hexbin(df: DataFrame, x: str, y: str, size: float, x_scale: float = 1.0, y_scale: float = 1.0) -> DataFrame:
    """Points per hexagonal cell after dividing each axis by its scale."""
    present = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    q, r = hex_cell(F.col(x) / x_scale, F.col(y) / y_scale, size)
    return present.groupBy(q.alias("cell_q"), r.alias("cell_r")).agg(F.count(F.lit(1)).alias("count"))


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))


def residual_histogram(df: DataFrame, actual: str, predicted: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal bins of the residuals between the least and the largest of each group; rows without both values are left out."""
    return histogram(residuals(df, actual, predicted), ["residual"], bins, by)
