"""From raw documents to numbered shards: five stages, each a table of its own.

Quality rules drop what they reject; of every group of near copies (five words, 0.8) the
document with the least id stays; documents that hold a benchmark item go; the mix
repeats a document as often as it takes its words, rounded to whole documents (none: it
goes); shards and slots are added last, in place of columns of those names; all others stay. ``run`` writes every stage to the shared folder
and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import decontaminate, jaccard, quality, shard_tree, source_schedule
from statloom.llm.tables import free_names, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_schedule.repeat(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("shard", "slot")])
    (size,) = free_names(docs, "size")
    sized = docs.withColumn(size, F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    placed = shard_tree.assign(sized, "doc_id", shard_tree.tree(16))
    return shard_tree.number(placed, "doc_id", docs.count(), ties=(size,)).drop(size)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("sharding", sharding),
]

ORACLE_SQL = None
"""The trained ratio of the first stage has no SQL; the tests compare with a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
