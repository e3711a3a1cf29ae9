"""Imputation, clipping, scaling and encoding of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from statloom.functions.scalars import clip, flag, without_nan
from statloom.operators.describe import QUARTILES, coefficient_of_variation, describe
from statloom.operators.selection import Rank, linear, long_form, pick, quantiles, value_counts
from statloom.operators.series import over_rows
from statloom.runtime import fixed, lookup, settle

UNKNOWN = "unknown"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() == "string"]


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact median of each column that has values."""
    return {r["variable"]: r["q"][0] for r in quantiles(df, cols, [0.5]).collect()} if cols else {}


def means(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols if row[c] is not None}


def text_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent text of each column, the smallest on ties."""
    if not cols:
        return {}
    counts = (
        df.select(*cols)
        .unpivot([], list(cols), "variable", "value")
        .where(F.col("value").isNotNull())
        .groupBy("variable", "value")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    best = F.min(F.struct((-F.col("c")).alias("c"), "value")).getField("value")
    return {r["variable"]: r["mode"] for r in counts.groupBy("variable").agg(best.alias("mode")).collect()}


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None})


def with_gaps(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Those of the columns that have a missing value, from one cheap aggregate."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols]).first() if cols else {}
    return [c for c in cols if counts[c]]


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill gaps, NaN among them, by the exact median; only columns with gaps are ranked."""
    df = without_nan(df, cols)
    return fill(df, medians(df, with_gaps(df, cols)))


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    df = without_nan(df, cols)
    return fill(df, means(df, cols))


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill text by its mode, or by a fixed word when nothing is present."""
    modes = text_modes(df, cols)
    return fill(df, {c: modes.get(c, UNKNOWN) for c in cols})


def impute_auto(df: DataFrame, skip: Sequence[str] = (), numeric: str = "median") -> DataFrame:
    """Fill numbers by median or mean and text by mode, chosen by column type."""
    numbers = [c for c in numeric_columns(df) if c not in skip]
    texts = [c for c in text_columns(df) if c not in skip]
    filled = impute_mean(df, numbers) if numeric == "mean" else impute_median(df, numbers)
    return impute_mode(filled, texts)


def clip_limits(df: DataFrame, cols: Sequence[str], k: float = 1.5, positive_only: bool = True) -> dict:
    """Fences per column; a column without spread is left alone when ``positive_only``."""
    out = {}
    for r in quantiles(df, cols, QUARTILES).collect():
        q1, _, q3 = r["q"]
        if q3 - q1 > 0 or not positive_only:
            out[r["variable"]] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def iqr_clip(
    df: DataFrame, cols: Sequence[str], k: float = 1.5, positive_only: bool = True, limits: dict | None = None
) -> DataFrame:
    """Clip columns to their fences.

    Pass ``limits`` computed on training rows to keep test rows out of the bounds.
    """
    df = without_nan(df, cols)
    limits = clip_limits(df, cols, k, positive_only) if limits is None else limits
    return df.withColumns({c: clip(F.col(c), F.lit(lo), F.lit(hi)) for c, (lo, hi) in limits.items()})


def clipped_share(df: DataFrame, limits: dict) -> DataFrame:
    """Share of present values that clipping would move, per column."""
    moved = df.agg(*[F.avg(flag((F.col(c) < lo) | (F.col(c) > hi))).alias(c) for c, (lo, hi) in limits.items()])
    return moved.unpivot([], list(limits), "variable", "clipped_fraction")


def clean(df: DataFrame, selected: Sequence[str], target: str) -> DataFrame:
    """Impute every column but the target, then clip the selected ones on the imputed values."""
    return iqr_clip(impute_auto(df, skip=[target]), selected)


def compare_states(raw: DataFrame, cleaned: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, deviation, IQR and range before and after cleaning, one row per variable."""
    measures = ["mean", "std", "iqr", "min", "max"]
    before, after = (
        describe(df, cols, mode=False).select("variable", *[F.col(m).alias(f"{m}_{state}") for m in measures])
        for df, state in ((raw, "raw"), (cleaned, "cleaned"))
    )
    ordered = [f"{m}_{s}" for m in measures for s in ("raw", "cleaned")]
    return before.join(after, "variable").select("variable", *ordered)


def states(raw: DataFrame, cleaned: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Describe tables of both states, stacked under a ``state`` column."""
    frames = [describe(d, cols).withColumn("state", F.lit(s)) for d, s in ((raw, "raw"), (cleaned, "cleaned"))]
    return frames[0].unionByName(frames[1])


def cleaned_states(df: DataFrame, cols: Sequence[str], k: float = 1.5, positive_only: bool = True) -> DataFrame:
    """What ``states`` gives for a table and its median-imputed, fence-clipped form, from one pass over the rows.

    The rows are counted by (variable, value) once, gaps among them, and everything else is read from these counts: the
    gaps move to the median, the fences follow from the filled counts, and since clipping keeps the order of values, the
    cleaned quartiles are the clipped order statistics of the filled column. Columns without any value are left out.
    """
    kept = without_nan(df.select(*cols), cols)
    doubles = kept.select(*[F.col(c).cast("double").alias(c) for c in cols])
    counted = fixed(value_counts(doubles.unpivot([], list(cols), "variable", "value"), ["variable"]))
    present = counted.where(F.col("value").isNotNull())

    def ranked(rows: DataFrame, counts: DataFrame, ranks: Sequence[Rank]) -> dict:
        sizes = settle(counts.groupBy("variable").agg(F.sum("c").alias("n")))
        return {r["variable"]: (r["n"], r["q"]) for r in pick(rows, ["variable"], sizes, ranks, counts).collect()}

    raw = ranked(long_form(kept, cols), present, [linear(p) for p in QUARTILES])
    if not raw:
        return describe(df, cols).withColumn("state", F.lit("raw"))
    names = F.create_map(*[F.lit(x) for c, (_, q) in raw.items() for x in (c, float(q[1]))])
    filled = counted.withColumn("value", F.coalesce("value", names[F.col("variable")])).where("value IS NOT NULL")
    filled = filled.groupBy("variable", "value").agg(F.sum("c").alias("c"))
    sides = [Rank(lambda n, p=p, f=f: f(linear(p).place(n)).cast("double")) for p in QUARTILES for f in (F.floor, F.ceil)]
    after = ranked(long_form(fill(kept, {c: q[1] for c, (_, q) in raw.items()}), list(raw)), filled, sides)

    def between(pairs: Sequence[float], n: int) -> list[float]:
        parts = [((n - 1) * p) % 1 for p in QUARTILES]
        return [a + (b - a) * t for a, b, t in zip(pairs[::2], pairs[1::2], parts)]

    facts = []
    for c, (n, q) in after.items():
        q1, _, q3 = between(q, n)
        low, high = float("-inf"), float("inf")
        if q3 - q1 > 0 or not positive_only:
            low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        shift, cut = float(raw[c][1][1]), between([min(max(v, low), high) for v in q], n)
        facts += [("raw", c, shift, None, None, *map(float, raw[c][1])), ("cleaned", c, shift, low, high, *map(float, cut))]
    shape = "state string, variable string, _shift double, _low double, _high double, p25 double, p50 double, p75 double"
    facts = F.broadcast(df.sparkSession.createDataFrame(facts, shape))

    both = counted.join(facts, "variable")
    value = F.when(F.col("state") == "raw", F.col("value")).otherwise(F.greatest("_low", F.least("_high", F.coalesce("value", "_shift"))))
    keys = ["state", "variable", "_shift", "p25", "p50", "p75"]
    merged = both.select(*keys, value.alias("value"), "c").where("value IS NOT NULL").groupBy(*keys, "value").agg(F.sum("c").alias("c"))
    d = F.col("value") - F.col("_shift")
    seen = merged.groupBy(*keys).agg(
        F.sum("c").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sum(F.col("c") * d).alias("_d"),
        F.sum(F.col("c") * d * d).alias("_d2"),
        F.min(F.struct((-F.col("c")).alias("c"), "value")).getField("value").alias("mode"),
    )
    n, off = F.col("count"), F.col("_d") / F.col("count")
    spread = F.greatest(F.col("_d2") - F.col("_d") * off, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))
    full = seen.withColumns({"mean": F.col("_shift") + off, "median": F.col("p50"), "variance": spread, "std": F.sqrt(spread)})
    full = full.withColumns({"range": F.col("max") - F.col("min"), "cv": coefficient_of_variation(F.col("std"), F.col("mean")), "iqr": F.col("p75") - F.col("p25")})
    measures = ["count", "mean", "median", "mode", "min", "max", "range", "variance", "std", "cv", "p25", "p50", "p75", "iqr"]
    return full.select("variable", *measures, "state")


def compare_cleaned(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """What ``compare_states`` gives for a table and its imputed, clipped form, from one pass over the rows."""
    measures = ["mean", "std", "iqr", "min", "max"]
    side = [F.max(F.when(F.col("state") == s, F.col(m))).alias(f"{m}_{s}") for m in measures for s in ("raw", "cleaned")]
    return cleaned_states(df, cols, k).groupBy("variable").agg(*side)


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale to 0..1; a constant column gives null, NaN counts as missing."""
    df = without_nan(df, cols)
    row = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in cols for f in (F.min, F.max)]).first()
    def scaled(c: str):
        lo, hi = row[f"min_{c}"], row[f"max_{c}"]
        return (F.col(c) - F.lit(lo)) / F.lit(float(hi - lo) if hi is not None and hi != lo else None).cast("double")
    return df.withColumns({f"{c}_scaled": scaled(c) for c in cols})


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Centre and divide by the population deviation; a constant column gives 0, NaN counts as missing."""
    df = without_nan(df, cols)
    row = df.agg(*[a for c in cols for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return df.withColumns({f"{c}_std": (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for c in cols})


def log1p(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_log1p": F.log1p(c) for c in cols})


def one_hot(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """One 0/1 column per known level; an unseen value is 0 in all of them."""
    return df.withColumns({f"{col}_{v}": flag(F.col(col) == F.lit(v)) for v in levels})


def category_codes(df: DataFrame, col: str) -> DataFrame:
    """Code of each distinct value: its place in sorted order, from 0."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    return over_rows(values, [col], lambda w, start: {"code": (F.row_number().over(w) + start - 1).cast("int")})


def encode(df: DataFrame, col: str) -> DataFrame:
    """Add the category code to each row, -1 for a missing value."""
    coded = lookup(df, category_codes(df, col), [col], "left")
    return coded.withColumn(f"{col}_code", F.coalesce("code", F.lit(-1))).drop("code")


def oversample(df: DataFrame, target: str) -> DataFrame:
    """Repeat the rows of smaller classes a whole number of times towards the largest."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.agg(F.max("_n")).first()[0]
    times = counts.select(target, F.greatest(F.lit(1), F.round(F.lit(float(top or 0)) / F.col("_n")).cast("int")).alias("_times"))
    copies = lookup(df, times, [target])
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


