"""Materialising intermediate results and joining them back safely.

Two rules hold throughout the library:

* A result that later steps must agree on (sketch brackets, chunk numbers) is
  fixed once, so that a lost executor cannot make a retried task see another
  version of it.
* A table is broadcast only after its row count has been seen to be small;
  beyond that bound the join is a shuffle join with salted hot keys.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 50_000
"""Most rows a table may have to be held on the driver and broadcast."""

HOT_ROWS = 10_000
"""Rows of one key beyond which a shuffle join deals them to several tasks."""


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a temporary one only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if shared:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared)
        return shared
    current = context.getCheckpointDir()
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="statloom-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


def fixed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def local_or_none(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """The rows as a local relation when there are at most ``max_rows``, else None."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return None
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def settle(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Fix a summary table: local (so Spark broadcasts it) if small, else checkpointed."""
    local = local_or_none(df, max_rows)
    return fixed(df) if local is None else local


def lookup(
    big: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    max_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Join ``big`` to a per-key ``table``.

    A table of proven small size is broadcast and ``big`` is not moved. Otherwise
    both sides are shuffled. Keys with more than ``HOT_ROWS`` rows, at most the
    ``SMALL_ROWS`` most frequent ones, are counted first: their rows are dealt to
    one slice for each ``HOT_ROWS`` by a hash of the ``spread`` columns and of the
    partition a row comes from, so that equal rows spread too. Only the table's
    rows of such a key are repeated, once per slice.
    """
    on = list(on)
    local = local_or_none(table, max_rows)
    if local is not None:
        return big.join(F.broadcast(local), on, how)
    hot = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_slices")).where(F.col("_slices") > HOT_ROWS)
    hot = hot.orderBy(F.desc("_slices")).limit(SMALL_ROWS).select(
        *[F.col(c).alias(f"_hot_{c}") for c in on], F.ceil(F.col("_slices") / HOT_ROWS).alias("_slices")
    )
    found = hot.toArrow()
    # Copies outgrow Spark's estimate of the table's size: the hint keeps them from being broadcast.
    if not found.num_rows:
        return big.join(table.hint("merge"), on, how)
    hot = F.broadcast(big.sparkSession.createDataFrame(found, schema=hot.schema))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in on])
    key = [*spread] or [c for c in big.columns if c not in on]
    salt = F.pmod(F.xxhash64(*key, F.spark_partition_id()), F.coalesce("_slices", F.lit(1)))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_slices", F.lit(1)) - 1))
    salted, sliced = (
        side.join(hot, same, "left").withColumn("_salt", number).drop("_slices", *[f"_hot_{c}" for c in on])
        for side, number in ((big, salt), (table, copies))
    )
    return salted.join(sliced.hint("merge"), [*on, "_salt"], how).drop("_salt")


def scalars(df: DataFrame) -> dict:
    """The single row of a global aggregate as a dict."""
    return df.first().asDict()


def scratch(spark: SparkSession) -> str:
    """A new folder name on the shared storage, for files that are written and read back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/statloom-{uuid.uuid4().hex}"
