"""Written intermediates, checked broadcasts, free names and places within groups."""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.runtime import scratch

BROADCAST_ROWS = 1_000_000
"""Most rows of a narrow table (at most three numbers a row) that is broadcast."""

SLICE_ROWS = 50_000
"""Rows that ``places`` aims at for one slice of one group."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows from Parquet files in the folder all executors share; survives lost executors."""
    path = f"{scratch(df.sparkSession)}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(narrow: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written narrow table, to be broadcast if its counted rows allow it; beyond, Spark shuffles."""
    return F.broadcast(narrow) if narrow.count() <= most else narrow


ARROW_ROWS = 2_000
"""Most rows in an Arrow batch."""

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, and keep Arrow batches of long texts small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, f"{package.name}/{path.relative_to(package)}")
    folder = Path(tempfile.mkdtemp(prefix="statloom-code-"))
    (folder / "statloom.zip").write_bytes(packed.getvalue())
    context.addPyFile(str(folder / "statloom.zip"))
    _SHIPPED.add(context.applicationId)


def arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the table has a column of that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def places(
    df: DataFrame, group: Sequence[str], shuffle: Column, order: Sequence[Column], amount: Column, into: str, rows: int
) -> DataFrame:
    """Add ``into``: the sum of ``amount`` over the rows before this one in its group.

    Rows of a group are ordered by a slice number, the low bits of ``shuffle`` (a
    long), and within a slice by ``order``. Only a slice, never a group, meets in
    one task; the number of slices follows ``rows``, the number of rows of the table.
    Rows equal in ``order`` take their places in any order.
    """
    slices = max(256, rows // SLICE_ROWS)
    cut, size, before = free_names(df, "_slice", "_size", "_before")
    cut_rows = df.withColumn(cut, F.pmod(shuffle, F.lit(slices)).cast("int")).withColumn(size, amount)
    sums = cut_rows.groupBy(*group, cut).agg(F.sum(size).alias(before))
    along = Window.partitionBy(*group).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before, F.coalesce(F.sum(before).over(along), F.lit(0)))
    within = Window.partitionBy(*group, cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut_rows.withColumn(into, F.coalesce(F.sum(size).over(within), F.lit(0)))
    return placed.join(sums, [*group, cut]).withColumn(into, F.col(into) + F.col(before)).drop(cut, size, before)
