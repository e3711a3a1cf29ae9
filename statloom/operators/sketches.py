"""Mergeable sketches, written once per small group and merged for any range of groups.

A sketch table has one row per group and variable: rows with a value, a HyperLogLog sketch of the distinct values, a KLL sketch of the
quantiles of numbers, and the extremes. Sketches have a fixed size whatever the rows they stand for, are built with map-side
combining (a hot group is merged, never collected), and merge without a look at the rows: a month is the union of its
days. Missing values and NaN count nowhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HLL_BITS = 14
"""Binary logarithm of the registers of a distinct-count sketch."""

KLL_SIZE = 800
"""Size parameter of a quantile sketch."""

MERGED = ("variable", "n", "hll", "kll", "least", "most")


def distinct_error(bits: int = HLL_BITS, sigmas: float = 5.0) -> float:
    """Relative error that an estimated distinct count keeps but for odds of about one in two million."""
    return sigmas * 1.04 / 2 ** (bits / 2)


def rank_error(size: int = KLL_SIZE) -> float:
    """Share of the rows by which the rank of an estimated quantile may be off, twice the error at 99 % confidence."""
    return 2 * 2.446 / size**0.9433


def sketch(
    df: DataFrame, by: Sequence[str], distinct: Sequence[str] = (), numeric: Sequence[str] = (), bits: int = HLL_BITS, size: int = KLL_SIZE
) -> DataFrame:
    """(by, variable, n, hll, kll, least, most) in one wide aggregate.

    ``distinct`` columns get a distinct-count sketch, ``numeric`` ones a quantile sketch and extremes; a column may be in both.
    """
    names = list(dict.fromkeys([*distinct, *numeric]))
    fields, aggregates = [], []
    for i, c in enumerate(names):
        kind = df.schema[c].dataType.typeName()
        present = F.col(c).isNotNull() & ~F.isnan(F.col(c)) if kind in ("double", "float") else F.col(c).isNotNull()
        value = F.when(present, F.col(c))
        number = value.cast("double") if c in numeric else F.lit(None).cast("double")
        hashed = value if kind in ("string", "long", "integer", "binary") else value.cast("string")
        aggregates += [F.count(value).alias(f"n{i}"), F.min(number).alias(f"least{i}"), F.max(number).alias(f"most{i}")]
        if c in distinct:
            aggregates.append(F.hll_sketch_agg(hashed, bits).alias(f"hll{i}"))
        if c in numeric:
            aggregates.append(F.kll_sketch_agg_double(number, size).alias(f"kll{i}"))
        parts = {"hll": c in distinct, "kll": c in numeric}
        binary = [(F.col(f"{p}{i}") if has else F.lit(None).cast("binary")).alias(p) for p, has in parts.items()]
        fields.append(F.struct(F.lit(c).alias("variable"), F.col(f"n{i}").alias("n"), *binary, F.col(f"least{i}").alias("least"), F.col(f"most{i}").alias("most")))
    return df.groupBy(*by).agg(*aggregates).select(*by, F.inline(F.array(*fields)))


def store(sketches: DataFrame, path: str) -> DataFrame:
    """Write a sketch table as Parquet files and read it back."""
    sketches.write.mode("errorifexists").parquet(path)
    return load(sketches.sparkSession, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge(sketches: DataFrame, by: Sequence = ()) -> DataFrame:
    """Sketches of the unions of groups, by columns or column expressions."""
    return sketches.groupBy(*by, "variable").agg(
        F.sum("n").alias("n"),
        F.when(F.count("hll") > 0, F.hll_union_agg("hll")).alias("hll"),
        F.when(F.count("kll") > 0, F.kll_merge_agg_double("kll")).alias("kll"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
    )


def distinct_counts(sketches: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, variable, n, estimate): estimated distinct values of each row that has a distinct-count sketch."""
    rows = sketches.where(F.col("hll").isNotNull())
    return rows.select(*keep, "variable", "n", F.hll_sketch_estimate("hll").alias("estimate"))


def quantiles(sketches: DataFrame, probs: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, variable, n, prob, estimate): estimated quantiles; rows without any value are left out."""
    rows = sketches.where(F.col("kll").isNotNull() & F.col("least").isNotNull())
    cells = [F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("kll", F.lit(float(p))).alias("estimate")) for p in probs]
    return rows.select(*keep, "variable", "n", F.inline(F.array(*cells)))


def check_quantiles(df: DataFrame, estimated: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Add to the estimated quantiles of one column the exact shares of rows below and up to each estimate, and whether both leave
    the wanted share within ``rank_error``."""
    points = estimated.where(F.col("variable") == column)
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("value"))
    counted = rows.join(points, list(by)).groupBy(*by, "variable", "n", "prob", "estimate").agg(
        F.avg((F.col("value") < F.col("estimate")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("estimate")).cast("double")).alias("up_to")
    )
    near = (F.col("below") <= F.col("prob") + rank_error()) & (F.col("up_to") >= F.col("prob") - rank_error())
    return counted.withColumn("within", near)
