"""Benchmark decontamination by size-partitioned MinHash containment.

A document holds a test item if it holds at least ``PERCENT`` per cent of the item's
distinct word shingles. Items are partitioned by the number of their shingles, in
powers of two. In each partition an item is represented by its lowest shingle hashes
(a bottom-k MinHash sketch), with k just above the number of shingles that any item of the
partition may miss: a document that holds the item then holds at least one hash of the
sketch, however long the document is, so the search loses nothing. Every candidate is
verified by counting the item's shingles in the document.

Only DataFrame functions run here. Texts are lower-cased; words are runs of bytes other
than blank, tab and line breaks; shingles have ``SIZE`` words. An item of fewer words is one shingle
of its own length, and documents then show their runs of that length too, so that it is found inside long ones. Null, empty and blank texts and items match nothing. Repeated rows
give one pair for each distinct (doc_id, item_id). Items of equal text are all found. Further columns
of any name stay as they are in ``clean`` and take no part otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.tables import free_names, hinted, written

SIZE = 5
PERCENT = 80


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def runs(df: DataFrame, key: str, text: str = "text", size: int = SIZE) -> tuple[DataFrame, list[str]]:
    """(k, n, at, w0 ..): the ``size`` words from each word on, null behind the text's end, and the names of the words."""
    # A generator, so that what reads the words does not repeat the split.
    split = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.inline(F.array(F.struct(words(text).alias("w")))))
    names = [f"w{i}" for i in range(size)]
    zipped = F.arrays_zip(*[F.slice("w", i + 1, F.greatest(F.size("w"), F.lit(1))).alias(n) for i, n in enumerate(names)])
    rows = split.filter(F.size("w") > 0).select("k", F.size("w").alias("n"), F.posexplode(zipped).alias("at", "g"))
    return rows.select("k", "n", "at", *[F.col(f"g.{n}") for n in names]), names


def shingles(df: DataFrame, key: str, text: str = "text", size: int = SIZE, shorter: Sequence[int] = ()) -> DataFrame:
    """One row (key, shingle) for every run of ``size`` words, and of each of the ``shorter`` sizes."""
    rows, names = runs(df, key, text, size)
    rows = rows.filter(F.col(names[min([size, *shorter]) - 1]).isNotNull())
    hashes = [F.when(F.col(names[s - 1]).isNotNull(), F.xxhash64(*names[:s])) for s in (*shorter, size)]
    one = hashes[0] if len(hashes) == 1 else F.explode(F.array_compact(F.array(*hashes)))
    return rows.select(F.col("k").alias(key), one.alias("shingle"))


def item_shingles(items: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct (item_id, shingle), with the number ``n`` of the item's shingles; an item of fewer than ``size`` words is one shingle."""
    rows, names = runs(items.filter("item_id IS NOT NULL"), "item_id", size=size)
    rows = rows.filter(F.col(names[-1]).isNotNull() | ((F.col("n") < size) & (F.col("at") == 0)))
    found = rows.select(F.col("k").alias("item_id"), F.xxhash64(*names).alias("shingle")).distinct()
    return found.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))


def short_sizes(items: DataFrame, size: int = SIZE) -> list[int]:
    """The word counts below ``size`` that items have."""
    count = F.size(words("text")).alias("n")
    found = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(count).filter((F.col("n") > 0) & (F.col("n") < size))
    return sorted(r["n"] for r in found.distinct().collect())


def sketches(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The lowest hashes of every item, as many as its size partition asks for."""
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    depth = F.floor(upper * (100 - percent) / 100) + 1
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("shingle"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= depth).select("item_id", "shingle")


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of every document that holds an item.

    Documents without doc_id and items without item_id are left out.
    """
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    whole, shorter = written(item_shingles(items)), short_sizes(items)
    sketch = hinted(written(sketches(whole, percent)))
    pairs = written(shingles(docs, "doc_id", shorter=shorter).join(sketch, "shingle").select("doc_id", "item_id").distinct())
    few = docs.join(hinted(written(pairs.select("doc_id").distinct())), "doc_id", "left_semi")
    shared = shingles(few, "doc_id", shorter=shorter).join(hinted(whole), "shingle").select("doc_id", "item_id", "n", "shingle").distinct()
    counts = shared.groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("n_shared"))
    right = counts.filter(100 * F.col("n_shared") >= percent * F.col("n")).join(pairs, ["doc_id", "item_id"], "left_semi")
    return right.select("doc_id", "item_id", "n_shared", F.col("n").alias("n_item"))


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that hold no item, with all their columns; those without doc_id are judged by their text."""
    (name,) = free_names(docs, "_key")
    by_id = F.concat(F.lit("i"), F.col("doc_id").cast("string"))
    keyed = docs.withColumn(name, F.coalesce(by_id, F.concat(F.lit("t"), F.md5(F.col("text").cast("binary")))))
    found = contained(keyed.select(F.col(name).alias("doc_id"), "text"), items, percent)
    bad = written(found.select(F.col("doc_id").alias(name)).distinct())
    return keyed.join(hinted(bad), name, "left_anti").drop(name)
