"""Reading delimited, blank-separated and tagged text, file names and images as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from statloom.functions.scalars import array_mean, array_std, first_prefix, squeeze, to_number, unescape
from statloom.operators.describe import stack
from statloom.operators.sampling import head_per_group


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """Delimited file with a header line; give a schema to avoid the extra pass that infers one."""
    reader = spark.read.options(header=True, **options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_headerless(spark: SparkSession, path: str, names: Sequence[str], missing: str = "?") -> DataFrame:
    """Delimited numbers without a header; the missing mark and unreadable cells become null."""
    text = spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("nullValue", missing).csv(path)
    return text.select(*[to_number(F.trim(n)).alias(n) for n in names])


def split_blanks(col: Column) -> Column:
    """Fields of a line separated by runs of white space."""
    return F.split(F.regexp_replace(col, r"^\s+|\s+$", ""), r"\s+")


def read_blank_separated(spark: SparkSession, path: str | list[str], names: Sequence[str]) -> DataFrame:
    """Blank-separated numbers with given column names, plus ``file`` and the row's place in it."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    lines = lines.where(F.trim("value") != "").withColumn("_line", F.monotonically_increasing_id())
    parts = split_blanks(F.col("value"))
    return lines.select(*[to_number(F.get(parts, i)).alias(n) for i, n in enumerate(names)], "file", "_block", "_line")


def head_per_file(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of each file."""
    return head_per_group(df, "file", ["_block", "_line"], n)


def name_part(col: Column, pattern: str, group: int = 1) -> Column:
    """Part of a file name or path by pattern."""
    return F.regexp_extract(col, pattern, group)


def feature_names(spark: SparkSession, path: str, prefix: str = "f") -> list[str]:
    """Column names from a side file of ``id name`` lines, numbered to be unique."""
    rows = read_pairs(spark, path).orderBy("code").collect()
    return [f"{prefix}{i:03d}_{r['label']}" for i, r in enumerate(rows, start=1)]


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A side file of ``code label`` lines."""
    parts = split_blanks(F.col("value"))
    return spark.read.text(path).select(
        F.get(parts, 0).try_cast("int").alias("code"), F.get(parts, 1).alias("label")
    )


def latin1(col: Column) -> Column:
    """Decode bytes, or text whose bytes were read unchanged, as ISO-8859-1."""
    return F.decode(col.cast("binary"), "ISO-8859-1")


def tag_body(col: Column, tag: str) -> Column:
    """Raw content of the first element of that name."""
    return F.regexp_extract(col, f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>", 1)


def tag_text(col: Column, tag: str) -> Column:
    """Content without inner tags and entities, blanks collapsed."""
    return squeeze(unescape(squeeze(F.regexp_replace(tag_body(col, tag), "<[^>]+>", " "))))


def tag_items(col: Column, tag: str, item: str = "D") -> Column:
    """Contents of the list items inside an element."""
    return F.regexp_extract_all(tag_body(col, tag), F.lit(f"(?is)<{item}>(.*?)</{item}>"), F.lit(1))


def read_tagged(
    spark: SparkSession,
    path: str,
    record: str,
    id_attribute: str,
    texts: Sequence[str],
    lists: Sequence[str] = (),
) -> DataFrame:
    """One row per record of tagged latin-1 text.

    The closing tag is the line separator, so a large file is split between tasks.
    """
    pieces = spark.read.option("lineSep", f"</{record}>").text(path).select(latin1(F.col("value")).alias("value"))
    rows = pieces.where(F.regexp_like("value", F.lit(f"(?is)<{record}\\b")))
    number = F.regexp_extract("value", f'(?i)\\b{id_attribute}="(\\d+)"', 1).try_cast("int")
    return rows.select(
        number.alias(id_attribute.lower()),
        *[tag_text(F.col("value"), t).alias(t.lower()) for t in texts],
        *[tag_items(F.col("value"), t).alias(t.lower()) for t in lists],
    )


def html_features(df: DataFrame, key: str, html: str) -> DataFrame:
    """Title, visible text length, words and links of web pages."""
    bare = F.regexp_replace(F.col(html), "(?is)<(script|style)\\b.*?</\\1>", " ")
    text = squeeze(unescape(F.regexp_replace(bare, "<[^>]+>", " ")))
    return df.select(
        key,
        tag_text(F.col(html), "title").alias("title"),
        F.char_length(text).alias("text_chars"),
        F.regexp_count(F.col(html), F.lit("(?i)<a\\s")).alias("links"),
    )


def image_features(spark: SparkSession, path: str) -> DataFrame:
    """Size, channels, mean and population deviation of the grey intensity of each image."""
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def grey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.array([114, 587, 299])  # fixed values: luma weights, stored order blue green red
        for batch in batches:
            means, deviations = [], []
            for data, channels in zip(batch["data"], batch["nChannels"]):
                pixels = np.frombuffer(data, np.uint8).reshape(-1, channels).astype(np.int64)
                level = pixels[:, 0] if channels == 1 else (pixels[:, :3] @ weights + 500) // 1000
                means.append(float(level.mean()))
                deviations.append(float(level.std()))
            batch = batch.drop(columns="data")
            yield batch.assign(mean_intensity=means, std_intensity=deviations)

    schema = "origin string, width int, height int, nChannels int, mean_intensity double, std_intensity double"
    rows = images.select("origin", "width", "height", "nChannels", "data").mapInPandas(grey, schema)
    stem = F.regexp_extract("origin", r"([^/]+)\.[^./]+$", 1)
    kind = F.lower(F.regexp_extract("origin", r"\.([^./]+)$", 1))
    return rows.withColumns({"image_id": stem, "format": kind}).withColumnRenamed("nChannels", "channels")


def join_on_stem(metadata: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Metadata with the features of its file, wherever the file was found."""
    return metadata.join(features, key)


def array_features(df: DataFrame, key: str, arr: str) -> DataFrame:
    """Mean, population deviation and extremes of an array column."""
    values = F.col(arr)
    return df.select(
        key,
        array_mean(values).alias("mean_value"),
        array_std(values).alias("std_value"),
        F.array_min(values).cast("double").alias("min_value"),
        F.array_max(values).cast("double").alias("max_value"),
    )


def file_catalogue(
    spark: SparkSession, root: str, kinds: Mapping[str, str], scopes: Sequence[str], default: str = "general"
) -> DataFrame:
    """All files below a folder with kind (by folder name), scope (by name prefix) and size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.lit("other")
    for folder, label in reversed(kinds.items()):
        kind = F.when(F.col("path").contains(f"/{folder}/"), F.lit(label)).otherwise(kind)
    return files.select(
        name.alias("artifact"),
        "path",
        kind.alias("artifact_type"),
        first_prefix(name, scopes, default).alias("scope"),
        F.col("length").alias("size_bytes"),
    )


def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    return stack(
        [
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns")
            )
            for name, df in tables.items()
        ]
    )
