"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix has the point frac(i * golden ratio), kept in 31-bit integers.
The cumulated targets of the sources cut [0, total) into intervals, and the point
names the source whose interval holds it; after any number of slots every source is
within a few slots of its share. The words of a source, its documents shuffled by a
hash, are cut into blocks of ``block_words``. The r-th slot of a source takes its
block r modulo the number of blocks, so blocks repeat only after all were taken; a
block is taken ``most`` times at most, which is also the bound on a target.

Null sources are one source, last in order. Documents without words take no part
(``taken`` 0). Repeated rows count each. A table without words gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.tables import free_names, hinted, places, written

CYCLE = 1 << 31
STEP = 1_327_217_885
"""CYCLE divided by the golden ratio, made odd."""

RANK_SLOTS = 16_384
"""Slots ranked together in one task."""


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per source: its rank by code point, size, target and interval of the cumulated targets.

    Sources weigh ``weights`` in turn. A level L gives each source L * weight words, at most
    ``most`` times its size; the level that shares out all words is found by taking
    sources in the order in which they reach their bound.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything, by_rank = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))) + 1)
    sized = sizes.withColumn("rank", F.row_number().over(by_rank) - 1).withColumn("weight", turn)
    sized = sized.withColumn("bound", most * F.col("source_size")).withColumn("total", F.sum("source_size").over(everything))
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), "rank")
    full = F.coalesce(F.sum("bound").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_bound.rowsBetween(0, Window.unboundedFollowing))
    sized = sized.withColumn("level", (F.col("total") - full) / rest)
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct(F.col("bound") / F.col("weight"), "rank", "level")))
    sized = sized.withColumn("level", level.over(everything)["level"])
    sized = sized.withColumn("target", F.least(F.col("level") * F.col("weight"), F.col("bound").cast("double")))
    high = F.sum("target").over(by_rank.rowsBetween(Window.unboundedPreceding, 0))
    return sized.select("source", "rank", "source_size", "target", "total", high.alias("high"), (high - F.col("target")).alias("low"))


def schedule(sources: DataFrame, block_words: int, most: int = 3) -> DataFrame:
    """One row per slot: (slot, rank of the source, block, epoch)."""
    size = sources.agg(F.max("total"), F.count("*")).first()
    total, cells = int(size[0] or 0), 1024 + 4 * size[1]
    slots = sources.sparkSession.range(-(-total // block_words)).withColumnRenamed("id", "slot")
    point = F.pmod(F.pmod(F.col("slot"), F.lit(CYCLE)) * F.lit(STEP), F.lit(CYCLE)) / F.lit(float(CYCLE)) * F.lit(float(total))
    wide = F.lit(max(total, 1) / cells)
    cell = lambda x: F.floor(x / wide)
    slots = slots.withColumn("point", point).withColumn("cell", cell(F.col("point")))
    last = F.max("rank").over(Window.partitionBy())
    held = sources.filter("target > 0").withColumn("high", F.when(F.col("rank") == last, F.lit(float(total + 1))).otherwise(F.col("high")))
    held = held.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    held = held.select("cell", "rank", "low", "high", F.ceil(F.col("source_size") / block_words).alias("blocks"))
    drawn = slots.join(held, "cell").filter("low <= point AND point < high").select("slot", "rank", "blocks")
    drawn = drawn.withColumn("run", F.floor(F.col("slot") / RANK_SLOTS))
    counts = drawn.groupBy("rank", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("rank", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("rank", "run").orderBy("slot")) - 1
    ranked = drawn.withColumn("nth", nth).join(counts, ["rank", "run"]).withColumn("nth", F.col("nth") + F.col("base"))
    ranked = ranked.withColumn("epoch", F.floor(F.col("nth") / F.col("blocks"))).filter(F.col("epoch") < most)
    return ranked.select("slot", "rank", F.pmod("nth", "blocks").alias("block"), "epoch")


def shuffled(docs: DataFrame, rows: int) -> DataFrame:
    """Add ``start``: the words of the source's documents before this one, in the shuffled order."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    mixed = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    order = [digest, F.col("doc_id").asc_nulls_first(), F.col("size")]
    return places(docs, ["rank"], mixed, order, F.col("size"), "start", rows)


def blend(docs: DataFrame, block_words: int = 128, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """For rows (doc_id, source, size): doc_id, size, source_size, target of the source and words taken."""
    docs = written(docs.select("doc_id", "source", F.col("size").cast("long").alias("size")))
    rows = docs.count()
    sources = written(targets(docs, weights, most).coalesce(1))
    ranked = docs.join(sources.select("source", "rank"), docs["source"].eqNullSafe(sources["source"])).select("doc_id", "size", "rank")
    placed = written(shuffled(ranked, rows))
    times = schedule(sources, block_words, most).groupBy("rank", "block").agg(F.count("*").alias("times"))
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    taken = pieces.withColumn("part", high - low).join(times, ["rank", "block"])
    taken = taken.groupBy("rank", "start").agg(F.sum(F.col("part") * F.col("times")).alias("taken"))
    here = (F.col("p.size") > 0) & (F.col("p.rank") == F.col("t.rank")) & (F.col("p.start") == F.col("t.start"))
    mixed = placed.alias("p").join(taken.alias("t"), here, "left").select("doc_id", "size", F.col("p.rank").alias("rank"), "taken")
    named = mixed.join(sources.select("rank", "source", "source_size", "target"), "rank")
    return named.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def repeat(docs: DataFrame, **how) -> DataFrame:
    """Documents as often as the mix takes them, with all their columns.

    A document's copies are its taken words over its words, rounded half up: at most
    ``most``, and none where the mix takes less than half of it. Rows that share a
    doc_id get their rounded mean. Rows without words go. Rows without doc_id stay once.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = blend(sized.filter("doc_id IS NOT NULL"), **how).filter("size > 0").groupBy("doc_id")
    (copies,) = free_names(docs, "_copies")
    share = F.sum(F.col("taken") / F.col("size")) / F.count("*")
    times = written(mixed.agg(F.floor(share + 0.5).cast("int").alias(copies)).filter(F.col(copies) > 0))
    held = docs.filter("doc_id IS NOT NULL").join(hinted(times), "doc_id")
    kept = held.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
    return kept.union(docs.filter(F.col("doc_id").isNull() & (word_count(F.col("text")) > 0)))
