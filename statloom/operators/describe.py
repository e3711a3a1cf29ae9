"""Central tendency, dispersion and shape of numeric columns, whole or per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.scalars import without_nan
from statloom.operators.selection import (
    Rank,
    linear,
    long_form,
    order_statistics,
    pick,
    quantiles,
    trim_high,
    trim_low,
    value_counts,
    weibull,
)
from statloom.runtime import lookup, settle

QUARTILES = (0.25, 0.5, 0.75)
NORMAL_MAD_FACTOR = 1.4826


def adjusted_skewness(value: Column, n: Column) -> Column:
    """Bias-adjusted skewness (null below three values)."""
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(value: Column, n: Column) -> Column:
    """Bias-adjusted excess kurtosis (null below four values)."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6))


def value_modes(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent value per key from its value counts, the smallest one on ties."""
    best = F.min(F.struct((-F.col("c")).alias("c"), "value")).getField("value")
    return counts.groupBy(*keys).agg(best.alias("mode"))


def mode_of(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The mode of each numeric column per group."""
    keys = [*by, "variable"]
    return value_modes(value_counts(long_form(df, cols, by), keys), keys)


def all_modes(df: DataFrame, col: str) -> DataFrame:
    """Every value that reaches the highest count."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("mode")).agg(F.count(F.lit(1)).alias("count"))
    top = counts.agg(F.max("count")).first()[0]
    return counts.where(F.col("count") == F.lit(top))


def describe(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = (),
    *,
    mode: bool = True,
    shape: bool = False,
) -> DataFrame:
    """One row per (group, variable); variables without any value are left out.

    One job gathers the moments; the exact quartiles and the mode are joined to
    that small table.
    """
    rows = long_form(df, cols, by)
    keys = [*by, "variable"]
    ranks = [linear(p) for p in QUARTILES]
    n = F.count("value")
    extra = [adjusted_skewness(F.col("value"), n).alias("skew"), adjusted_kurtosis(F.col("value"), n).alias("kurtosis")]
    core = settle(
        rows.groupBy(*keys).agg(
            n.alias("n"),
            F.avg("value").alias("mean"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.var_samp("value").alias("variance"),
            F.stddev_samp("value").alias("std"),
            *(extra if shape else []),
        )
    )
    # The mode needs every distinct value counted; the quartiles then start from those counts.
    counts = value_counts(rows, keys) if mode else None
    out = core.join(pick(rows, keys, core, ranks, counts).drop("n"), keys)
    if mode:
        out = out.join(value_modes(counts, keys), keys)
    q = F.col("q")
    return out.select(
        *keys,
        F.col("n").alias("count"),
        "mean",
        q[1].alias("median"),
        *(["mode"] if mode else []),
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("range"),
        "variance",
        "std",
        coefficient_of_variation(F.col("std"), F.col("mean")).alias("cv"),
        q[0].alias("p25"),
        q[1].alias("p50"),
        q[2].alias("p75"),
        (q[2] - q[0]).alias("iqr"),
        *(["skew", "kurtosis"] if shape else []),
    )


def coefficient_of_variation(std: Column, mean: Column) -> Column:
    return std / F.nullif(mean, F.lit(0.0))


def extend_summary(summary: DataFrame) -> DataFrame:
    """Add range, variance, cv and iqr to a stored describe table."""
    return summary.withColumns(
        {
            "range": F.col("max") - F.col("min"),
            "variance": F.col("std") * F.col("std"),
            "cv": coefficient_of_variation(F.col("std"), F.col("mean")),
            "iqr": F.col("p75") - F.col("p25"),
        }
    )


def shape(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adjusted skewness and excess kurtosis."""
    n = F.count("value")
    return (
        long_form(df, cols, by)
        .groupBy(*by, "variable")
        .agg(
            n.alias("n"),
            adjusted_skewness(F.col("value"), n).alias("skew"),
            adjusted_kurtosis(F.col("value"), n).alias("kurtosis"),
        )
    )


def deviations(df: DataFrame, cols: Sequence[str], by: Sequence[str], centre: DataFrame) -> DataFrame:
    """Absolute deviations from a per-(group, variable) ``centre`` column."""
    rows = lookup(long_form(df, cols, by), settle(centre), [*by, "variable"])
    return rows.select(*by, "variable", F.abs(F.col("value") - F.col("centre")).alias("value"))


def median_abs_deviation(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median absolute deviation and the robust sigma derived from it."""
    keys = [*by, "variable"]
    centre = quantiles(df, cols, [0.5], by).select(*keys, F.col("q")[0].alias("centre"))
    spread = order_statistics(deviations(df, cols, by, centre), keys, [linear(0.5)])
    mad = F.col("q")[0]
    return spread.select(*keys, "n", mad.alias("mad"), (mad * NORMAL_MAD_FACTOR).alias("robust_sigma"))


def mean_abs_deviation(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute deviation about the mean."""
    keys = [*by, "variable"]
    centre = long_form(df, cols, by).groupBy(*keys).agg(F.avg("value").alias("centre"))
    return deviations(df, cols, by, centre).groupBy(*keys).agg(F.avg("value").alias("mean_abs_dev"))


def group_describe(df: DataFrame, cols: Sequence[str], target: str, labels: dict | None = None) -> DataFrame:
    """Seventeen measures of each variable per target group."""
    keys = [target, "variable"]
    base = describe(df, cols, [target], mode=False, shape=True).withColumnRenamed("count", "n")
    mad = median_abs_deviation(df, cols, [target]).select(*keys, "mad")
    text = F.col(target).cast("string")
    for code, label in (labels or {}).items():
        text = F.when(F.col(target) == F.lit(code), F.lit(label)).otherwise(text)
    return base.join(mad, keys).select(
        "variable",
        target,
        text.alias("group_label"),
        "n",
        "mean",
        "median",
        (F.col("mean") - F.col("median")).alias("mean_minus_median"),
        "std",
        "variance",
        "cv",
        "iqr",
        "mad",
        "range",
        "min",
        "max",
        "skew",
        "kurtosis",
    )


def weibull_percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Percentiles at place (n + 1) p, one row per (variable, prob)."""
    probs = sorted(probs)
    table = quantiles(df, cols, probs, method=weibull)
    pair = F.posexplode("q").alias("_i", "value")
    at = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1)
    return table.select("variable", pair).select("variable", at.alias("prob"), "value")


def trimmed_mean(df: DataFrame, cols: Sequence[str], alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean after cutting floor(alpha n) values at each end, ties split exactly."""
    keys = [*by, "variable"]
    rows = long_form(df, cols, by)
    ranks: list[Rank] = [trim_low(alpha), trim_high(alpha)]
    ends = settle(
        order_statistics(rows, keys, ranks).select(
            *keys, "n", F.col("q")[0].alias("_lo"), F.col("q")[1].alias("_hi"), F.floor(F.col("n") * alpha).alias("_cut")
        )
    )
    v, lo, hi = F.col("value"), F.col("_lo"), F.col("_hi")
    sums = (
        lookup(rows, ends, keys)
        .groupBy(*keys, "n", "_lo", "_hi", "_cut")
        .agg(
            F.sum(F.when((v > lo) & (v < hi), v).otherwise(0.0)).alias("_inner"),
            F.sum(F.when(v <= lo, 1).otherwise(0)).alias("_to_lo"),
            F.sum(F.when(v < hi, 1).otherwise(0)).alias("_under_hi"),
        )
    )
    kept = F.col("n") - 2 * F.col("_cut")
    at_lo = (F.col("_to_lo") - F.col("_cut")) * lo
    at_hi = (F.col("n") - F.col("_cut") - F.col("_under_hi")) * hi
    mean = F.when(lo == hi, lo).otherwise((F.col("_inner") + at_lo + at_hi) / kept)
    return sums.select(*keys, kept.alias("kept"), mean.alias("trimmed_mean"))


def geometric_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """exp of the mean log over positive values."""
    return (
        long_form(df, cols)
        .where("value > 0")
        .groupBy("variable")
        .agg(F.count("value").alias("n"), F.exp(F.avg(F.log("value"))).alias("geometric_mean"))
    )


def missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percent of every column from one aggregate."""
    cols = list(cols or df.columns)
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    empty = {c: (F.col(c).isNull() | F.isnan(c)) if c in numeric else F.col(c).isNull() for c in cols}
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.coalesce(F.sum(empty[c].cast("bigint")), F.lit(0)).alias(c) for c in cols],
    )
    long = counts.unpivot("_rows", cols, "variable", "missing_count")
    return long.select(
        "variable",
        "missing_count",
        (F.col("missing_count") * 100.0 / F.nullif("_rows", F.lit(0))).alias("missing_percent"),
    )


def distinct_counts(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Distinct non-null values per column.

    Exact counts aggregate twice (value, then column), so that a hot value is
    folded before the shuffle; ``exact=False`` uses a sketch.
    """
    cols = list(cols)
    if not exact:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).unpivot([], cols, "variable", "distinct")
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    seen = text.unpivot([], cols, "variable", "value").where(F.col("value").isNotNull()).distinct()
    return seen.groupBy("variable").agg(F.count(F.lit(1)).alias("distinct"))


def correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form; each pair uses the rows where both are present and not NaN."""
    cols = list(cols)
    df = without_nan(df, cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    def one(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.corr(F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double")))
    wide = df.agg(*[one(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"{i}").alias("r")))
    return wide.select(F.inline(F.array(*cells)))


def zscore(df: DataFrame, col: str, cut: float = 3.0) -> DataFrame:
    """Add ``z`` and the flag |z| > cut, from the sample mean and deviation; NaN counts as missing."""
    df = without_nan(df, [col])
    s = df.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).first()
    spread = F.lit(s["s"]) if s["s"] else F.lit(None).cast("double")
    z = (F.col(col) - F.lit(s["m"])) / spread
    return df.withColumn("z", z).withColumn("is_outlier", F.coalesce(F.abs("z") > cut, F.lit(False)).cast("int"))


def fences(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """Quartiles and the limits Q1 - k IQR and Q3 + k IQR."""
    q = F.col("q")
    iqr = q[2] - q[0]
    return quantiles(df, cols, QUARTILES, by).select(
        *by,
        "variable",
        "n",
        q[0].alias("q1"),
        q[1].alias("median"),
        q[2].alias("q3"),
        (q[0] - iqr * k).alias("lower"),
        (q[2] + iqr * k).alias("upper"),
    )


def outlier_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Values outside the fences per column."""
    keys = [*by, "variable"]
    limits = settle(fences(df, cols, by).select(*keys, "lower", "upper"))
    out = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return (
        lookup(long_form(df, cols, by), limits, keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(out.cast("bigint")).alias("outliers"))
    )


def stack(frames: Sequence[DataFrame], fill_missing: bool = False) -> DataFrame:
    """UNION ALL by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill_missing), frames)
