"""Frequency tables, shares, cross tables and top categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.runtime import lookup


def frequency(df: DataFrame, col: str) -> DataFrame:
    """Counts and shares of all rows, missing kept as a class of its own."""
    total = df.count()
    return (
        df.groupBy(col)
        .agg(F.count(F.lit(1)).alias("absolute_frequency"))
        .withColumn("relative_frequency", F.col("absolute_frequency") / F.lit(float(total)))
    )


def frequency_many(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Frequency tables of several columns from one pass, values as text."""
    cols = list(cols)
    total = df.count()
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return (
        text.unpivot([], cols, "variable", "value")
        .groupBy("variable", "value")
        .agg(F.count(F.lit(1)).alias("absolute_frequency"))
        .withColumn("relative_frequency", F.col("absolute_frequency") / F.lit(float(total)))
    )


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Counts and percent of the present values only."""
    present = df.where(F.col(col).isNotNull())
    total = present.count()
    return (
        present.groupBy(col)
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("percent", F.col("count") * 100.0 / F.lit(float(total)))
    )


def pie(df: DataFrame, col: str) -> DataFrame:
    """Share and angle in degrees of each category."""
    return frequency(df, col).select(
        col, F.col("relative_frequency").alias("share"), (F.col("relative_frequency") * 360.0).alias("angle")
    )


def levels_of(df: DataFrame, *cols: str) -> list:
    """Sorted present values of class columns; they become columns or cells of a table, so they are few."""
    found = df.select(F.explode(F.array(*cols)).alias("v")).where(F.col("v").isNotNull()).distinct()
    return sorted(r["v"] for r in found.collect())


def crosstab(df: DataFrame, rows: str, cols: str, levels: Sequence | None = None, prefix: str = "") -> DataFrame:
    """Contingency table with one column per level (by default every level of rows that have both); empty cells are 0."""
    both = df.where(F.col(rows).isNotNull() & F.col(cols).isNotNull())
    levels = levels_of(both, cols) if levels is None else levels
    cells = [F.count(F.when(F.col(cols) == F.lit(v), 1)).alias(f"{prefix}{v}") for v in levels]
    return both.groupBy(rows).agg(*cells) if cells else both.select(rows).distinct()


def crosstab_percent(df: DataFrame, rows: str, cols: str, levels: Sequence | None = None, prefix: str = "") -> DataFrame:
    """Contingency table with row totals and the percent of each class's own rows."""
    if levels is None:
        levels = levels_of(df.where(F.col(rows).isNotNull()), cols)
    names = [f"{prefix}{v}" for v in levels]
    table = crosstab(df, rows, cols, levels, prefix)
    present = df.where(F.col(rows).isNotNull())
    sums = present.agg(F.count(F.lit(1)), *[F.count(F.when(F.col(cols) == F.lit(v), 1)).alias(n) for v, n in zip(levels, names)]).first()
    total = sum((F.col(n) for n in names), F.lit(0).cast("bigint"))
    return table.select(
        rows,
        *names,
        total.alias("total"),
        *[
            (F.col(n) * 100.0 / F.lit(float(sums[n]) if sums[n] else None).cast("double")).alias(f"{n}_pct_within_group")
            for n in names
        ],
    )


def crosstab_long(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """Counts per pair of categories, only pairs that occur."""
    return (
        df.where(F.col(rows).isNotNull() & F.col(cols).isNotNull())
        .groupBy(rows, cols)
        .agg(F.count(F.lit(1)).alias("count"))
    )


def top_categories(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent present values; equal counts in key order."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc(col))
        .limit(k)
    )


def keep_top(df: DataFrame, col: str, k: int) -> DataFrame:
    """Rows whose category is among the k most frequent."""
    return df.join(F.broadcast(top_categories(df, col, k).select(col)), col, "left_semi")


def top_or_rest(df: DataFrame, col: str, k: int, out: str = "in_top") -> DataFrame:
    """Mark rows in the k most frequent categories with 1, the rest with 0."""
    top = top_categories(df, col, k).select(col, F.lit(1).alias(out))
    return df.join(F.broadcast(top), col, "left").fillna(0, [out])


def target_rate(df: DataFrame, category: str, target: str) -> DataFrame:
    """Mean of a 0/1 target per category."""
    return df.groupBy(category).agg(F.avg(target).alias("target_rate"))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weight n / (k n_c) of each class."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return counts.select(target, "n", (F.lit(float(totals["n"] or 0)) / (F.lit(totals["k"]) * F.col("n"))).alias("weight"))


def duplicate_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that occur more than once, named by a digest of their values.

    Grouping by the digest instead of the values keeps long texts out of the shuffle.
    """
    if len(cols) == 1:
        digest = F.md5(F.col(cols[0]).cast("string"))
    else:
        # Lengths keep the parts apart, and null differs from every text.
        texts = [F.col(c).cast("string") for c in cols]
        digest = F.md5(F.concat(*[F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in texts]))
    return df.groupBy(digest.alias("row_md5")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def domain_violations(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside the allowed range per column."""
    counts = df.agg(
        *[
            F.coalesce(F.sum(((F.col(c) < lo) | (F.col(c) > hi)).cast("bigint")), F.lit(0)).alias(c)
            for c, (lo, hi) in ranges.items()
        ]
    )
    return counts.unpivot([], list(ranges), "variable", "violations")


def label_lookup(df: DataFrame, table: DataFrame, on: str, spread: Sequence[str] = ()) -> DataFrame:
    """Left join of facts to a label table."""
    return lookup(df, table, [on], "left", spread)
