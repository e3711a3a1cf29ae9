"""Windowed aggregates of event streams, drained from files and read back as tables.

The aggregates take a streaming or a batch DataFrame alike. ``watermark`` bounds the state: rows older than the largest time seen, less the
delay, are dropped once a batch has moved the mark. ``drain`` works off all files there are, in as many batches
as asked for, and stops; its checkpoint lies in the shared folder, so a lost driver or executor resumes where it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from statloom.runtime import scratch


def stream_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder, or those that a pattern names, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def watermark(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Accept rows up to ``delay`` behind the latest; the time column becomes an instant."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def measures(col: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean_value"), F.min(col).alias("min_value"), F.max(col).alias("max_value")]


def tumbling(df: DataFrame, ts: str, col: str, width: str, by: Sequence[str] = (), step: str | None = None) -> DataFrame:
    """Rows, mean and range per window and group; with ``step``, windows overlap."""
    return df.groupBy(F.window(ts, width, step or width).alias("w"), *by).agg(*measures(col)).select(
        *by, F.col("w.start").alias("window_start"), "n", "mean_value", "min_value", "max_value"
    )


def sessions(df: DataFrame, ts: str, col: str, gap: str, by: Sequence[str]) -> DataFrame:
    """The same per session: rows of a group no further than ``gap`` apart."""
    return df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*measures(col)).select(
        *by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean_value", "min_value", "max_value"
    )


def drain(stream: DataFrame, keys: Sequence[str], mode: str = "update", path: str | None = None) -> DataFrame:
    """Run the stream over all files there are and return its result table.

    ``update`` writes the groups that a batch changed; of each key the latest batch counts. ``complete`` writes all groups each time; the
    last batch counts. ``append`` writes a group once, when the watermark has passed it. A batch that is run again
    after a failure replaces its own files.
    """
    spark = stream.sparkSession
    path = path or scratch(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = spark.read.schema(StructType(list(stream.schema.fields)).add("batch", "long")).parquet(f"{path}/out")
    if mode == "append":
        return seen.drop("batch")
    if mode == "complete":
        return seen.where(F.col("batch") == seen.agg(F.max("batch")).first()[0]).drop("batch")
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return seen.withColumn("_latest", latest).where("_latest = 1").drop("batch", "_latest")
