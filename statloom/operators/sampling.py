"""Exact, repeatable samples and splits in the order of a row hash.

Rows are counted per class and hash slice first. Whole slices below the cut are
taken as they are; only the slice that the cut falls into is ranked, so no class
is ever sorted in one task. ``key`` must identify a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.scalars import hash_bucket, order_hash
from statloom.runtime import lookup

SLICES = 4096


def marked(df: DataFrame, key: str, quota: Callable[[Column], Column], by: str | None, seed: int) -> DataFrame:
    """Add ``_taken``: whether the row is among the first ``quota(n)`` of its class in hash order."""
    cls = F.col(by) if by else F.lit(0)
    hashed = df.withColumns({"_class": cls, "_digest": order_hash(F.col(key), seed)})
    hashed = hashed.withColumn("_slice", hash_bucket(F.col("_digest"))).where(F.col("_class").isNotNull())
    counts = hashed.groupBy("_class", "_slice").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("_class")
    run = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select("_class", "_slice", "c", F.sum("c").over(run).alias("cum"), F.sum("c").over(group).alias("n"))
    want = quota(F.col("n")).cast("bigint")
    cut = placed.select(
        "_class",
        "_slice",
        F.when(F.col("cum") <= want, F.lit(1))
        .when(F.col("cum") - F.col("c") >= want, F.lit(0))
        .otherwise(F.lit(2))
        .alias("side"),
        (want - F.col("cum") + F.col("c")).alias("left"),
    )
    limits = cut.groupBy("_class").agg(
        F.max(F.when(F.col("side") == 1, F.col("_slice"))).alias("_full"),
        F.max(F.when(F.col("side") == 2, F.col("_slice"))).alias("_edge"),
        F.max(F.when(F.col("side") == 2, F.col("left"))).alias("_left"),
    )
    joined = lookup(hashed, limits, ["_class"], spread=[key])
    inside = F.coalesce(F.col("_slice") <= F.col("_full"), F.lit(False))
    on_edge = F.coalesce(F.col("_slice") == F.col("_edge"), F.lit(False))
    edge = joined.where(on_edge)
    order = Window.partitionBy("_class").orderBy("_digest", key)
    ranked = edge.withColumn("_taken", F.row_number().over(order) <= F.col("_left"))
    rest = joined.where(~on_edge).withColumn("_taken", inside)
    return rest.unionByName(ranked).select(*df.columns, "_taken")


def _take(df: DataFrame, key: str, quota: Callable[[Column], Column], by: str | None, seed: int) -> DataFrame:
    return marked(df, key, quota, by, seed).where("_taken").drop("_taken")


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows."""
    return _take(df, key, lambda size: F.least(size, F.lit(n)), None, seed)


def cap_per_class(df: DataFrame, key: str, by: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each class."""
    return _take(df, key, lambda size: F.least(size, F.lit(cap)), by, seed)


def stratified_sample(df: DataFrame, key: str, by: str, n: int, seed: int = 42) -> DataFrame:
    """About n rows with the class shares of the whole: round(n share) of each class."""
    total = df.where(F.col(by).isNotNull()).count()
    return _take(df, key, lambda size: F.round(size * F.lit(n / max(total, 1))), by, seed)


def stratified_split(df: DataFrame, key: str, by: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Mark ceil(share n) rows of each class as ``train`` and the others as ``test``."""
    rows = marked(df, key, lambda size: F.ceil(size * F.lit(share)), by, seed)
    return rows.withColumn("split", F.when(F.col("_taken"), "train").otherwise("test")).drop("_taken")


def head_per_group(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group.

    Small n is cut on the map side by Spark's window group limit. For a larger n
    each group is first cut within hashed slices, then across them.
    """
    cut = Window.partitionBy(by).orderBy(*order)
    if n > 1000:
        slices = Window.partitionBy(by, "_s").orderBy(*order)
        df = (
            df.withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(512)))
            .withColumn("_r", F.row_number().over(slices))
            .where(F.col("_r") <= n)
            .drop("_s", "_r")
        )
    return df.withColumn("_r", F.row_number().over(cut)).where(F.col("_r") <= n).drop("_r")
