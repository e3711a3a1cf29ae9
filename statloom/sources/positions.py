"""Row positions of text files, and joins by position.

A file that is read in blocks has no row numbers: each task sees a block. Here every row keeps its file, the start of its block and
its place among the rows of its task; a count of the rows of each block, added up in the order of file names and
block starts, then turns the place into the row's number over all files. No row is moved to be numbered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from statloom.runtime import fixed, lookup


def read_numbered(spark: SparkSession, path: str | list[str], schema: StructType | str, position: str = "position", **options: str) -> DataFrame:
    """Rows of delimited files with ``position``, from 0 over all files in the order of their names.

    The rows are checkpointed with their places, so that every later task agrees on them.
    """
    rows = spark.read.options(**options).schema(schema).csv(path)
    marks = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}
    rows = fixed(rows.select("*", *[c.alias(n) for n, c in marks.items()]))
    blocks = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # One row for each block of the input, some 128 MB: few enough for one task.
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    placed = lookup(rows, blocks, ["_file", "_block"], spread=["_at"])
    return placed.withColumn(position, F.col("_before") + F.col("_at") - F.col("_first")).drop("_file", "_block", "_at", "_first", "_before")


def bind(left: DataFrame, right: DataFrame, position: str = "position", suffix: str = "_right") -> DataFrame:
    """Two tables side by side, row by row. A column of the right whose name the left has gets the suffix; where one table
    is shorter, its columns are null."""
    taken = {c.lower() for c in left.columns}
    names = {c: c + suffix for c in right.columns if c != position and c.lower() in taken}
    return left.join(right.withColumnsRenamed(names), position, "full")


def write_parts(df: DataFrame, path: str, order: Sequence[str], parts: int, **options: str) -> None:
    """Write delimited files whose names follow the order of the rows."""
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.options(**options).csv(path)
