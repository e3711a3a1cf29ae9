"""Document features, word statistics and term weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from statloom.functions.scalars import clip, sentences, word_count, words

NO_TOPIC = "NO_TOPIC"

PART_CHARS = 8_000_000
"""Characters of text, times the lengths of terms, that ``tf_idf`` aims at for one part."""

PART_WORDS = 4_000_000
"""Words of a part beyond which ``count_terms`` merges equal ones before it reads on."""

BATCH_ROWS = 10_000
"""Rows of counts that ``count_terms`` hands on at once."""

# Frequent English function words.
STOP_WORDS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or our she so that the "
    "their them there they this to was we were which will with you your"
).split()


def primary_topic(topics: Column) -> Column:
    """First topic of a list, or a fixed mark."""
    return F.coalesce(F.try_element_at(topics, F.lit(1)), F.lit(NO_TOPIC))


def text_features(df: DataFrame, key: str, text: str) -> DataFrame:
    """Words and characters of each document that has a word."""
    counted = df.select(key, word_count(F.col(text)).alias("word_count"), F.char_length(text).alias("char_count"))
    return counted.where("word_count > 0")


def document_features(df: DataFrame, key: str, texts: Sequence[str], topics: str) -> DataFrame:
    """Topic columns and lengths of documents with a topic list."""
    joined = F.trim(F.concat_ws(" ", *texts))
    return df.select(
        key,
        F.array_join(topics, ";").alias("topics"),
        primary_topic(F.col(topics)).alias("primary_topic"),
        word_count(joined).alias("word_count"),
        F.char_length(joined).alias("char_count"),
    )


def fixed_clip(df: DataFrame, key: str, col: str, upper: float) -> DataFrame:
    """Values cut at an upper bound for display."""
    return df.select(key, clip(F.col(col), high=F.lit(upper)).alias(col))


def label_counts(df: DataFrame, labels: str) -> DataFrame:
    """Documents per label, counting every label of a document once."""
    single = df.select(F.explode(F.array_distinct(labels)).alias("label"))
    return single.groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per lower-case word."""
    return df.select(key, F.explode(words(F.lower(text))).alias("term"))


def sentence_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, sentences(F.col(text)).alias("sentences"))


def english_stop_words() -> list[str]:
    """Spark's own longer list; needs a running session."""
    return StopWordsRemover.loadDefaultStopWords("english")


def stop_word_ratio(df: DataFrame, key: str, text: str, stop_words: Sequence[str]) -> DataFrame:
    """Share of stop words among the words of each document, null without words."""
    listed = F.array(*[F.lit(w) for w in stop_words])
    all_words = words(F.lower(text))
    hits = F.size(F.filter(all_words, lambda w: F.array_contains(listed, w)))
    return df.select(key, (hits / F.nullif(F.size(all_words), F.lit(0))).alias("stop_ratio"))


def word_frequency(df: DataFrame, key: str, text: str) -> DataFrame:
    """Occurrences and documents of each word."""
    per_doc = tokens(df, key, text).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("term").agg(F.sum("tf").alias("count"), F.count(F.lit(1)).alias("documents"))


def bigram_frequency(df: DataFrame, text: str) -> DataFrame:
    """Occurrences of pairs of neighbouring words."""
    w = words(F.lower(text))
    pairs = F.zip_with(
        F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))),
        F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    split = df.select(w.alias("_w")).where(F.size("_w") > 1)
    return split.select(F.explode(pairs).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("count"))


def grams(split: Column, n: int) -> Column:
    """All runs of n neighbouring words, joined by one blank, of an array of words."""
    starts = F.sequence(F.lit(1), F.size(split) - (n - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(split, i, n), " "))
    return F.when(F.size(split) >= n, runs).otherwise(F.array().cast("array<string>"))


def gram_terms(text: Column, lengths: Sequence[int]) -> Column:
    """All runs of as many lower-case words as ``lengths`` names."""
    split = words(F.lower(text))
    if list(lengths) == [1]:
        return split
    # As the only item of an array, so that a text is split once.
    return F.flatten(F.transform(F.array(split), lambda w: F.concat(*[grams(w, n) for n in lengths])))


def count_terms(batches: Iterator[pa.RecordBatch], by_key: bool) -> Iterator[pa.RecordBatch]:
    """Counts of the terms of a part, whose rows are texts (part, key, null, terms) and known sums (part, null, documents, [term]).

    One row for each key and term, or only one for each term, without key, count and known sum.
    """
    held, waiting = [], 0
    for batch in batches:
        part, key, df, listed = batch.columns
        row = pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(listed).to_numpy(zero_copy_only=False)))
        if not len(row):
            continue
        one = pa.array(np.ones(len(row), np.int64))
        held.append(pa.table([*[c.take(row) for c in (part, key, df)], listed.flatten(), one], ["part", "key", "df", "term", "tf"]))
        waiting += len(row)
        if waiting > PART_WORDS:  # many rows of a frequent key
            merged = pa.concat_tables(held).group_by(["part", "key", "df", "term"], use_threads=False).aggregate([("tf", "sum")])
            held, waiting = [merged.rename_columns({"tf_sum": "tf"}).select(["part", "key", "df", "term", "tf"])], 0
    if not held:
        return
    part, key, df, term, tf = (c.combine_chunks() for c in pa.concat_tables(held).columns)
    key, term, tf = key.dictionary_encode("encode"), term.dictionary_encode(), tf.to_numpy()
    places, which = np.unique(part.to_numpy().astype(np.int64), return_inverse=True)
    # One number for a (part, key, term), and one for a (part, term).
    width, wide = len(term.dictionary), len(key.dictionary)
    spot = which * width + term.indices.to_numpy()
    told = np.flatnonzero(df.is_valid().to_numpy(zero_copy_only=False))
    sums = np.full(len(places) * width, -1, np.int64)
    sums[spot[told]] = df.take(pa.array(told)).to_numpy()
    texts = np.flatnonzero(~df.is_valid().to_numpy(zero_copy_only=False))
    pairs, same = np.unique(spot[texts] * wide + key.indices.to_numpy()[texts], return_inverse=True)
    counts = np.bincount(same, tf[texts]).astype(np.int64)
    spot, key_at = pairs // wide, pairs % wide
    documents = np.bincount(spot, minlength=len(sums))
    if not by_key:
        spot = np.flatnonzero(documents)
        for at in range(0, len(spot), BATCH_ROWS):
            some = spot[at : at + BATCH_ROWS]
            found = [pa.array(places[some // width], pa.int32()), term.dictionary.take(pa.array(some % width)), pa.array(documents[some], pa.int64())]
            yield pa.RecordBatch.from_arrays(found, names=["_part", "term", "_df"])
        return
    here = documents[spot]
    ordered = np.lexsort((spot, key_at))
    spot, key_at, counts, here = spot[ordered], key_at[ordered], counts[ordered], here[ordered]
    for at in range(0, len(spot), BATCH_ROWS):
        cut = slice(at, at + BATCH_ROWS)
        found = sums[spot[cut]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(places[spot[cut] // width], pa.int32()),
                key.dictionary.take(pa.array(key_at[cut])),
                term.dictionary.take(pa.array(spot[cut] % width)),
                pa.array(counts[cut], pa.int64()),
                pa.array(here[cut], pa.int64()),
                pa.array(found, pa.int64(), mask=found < 0),
            ],
            names=["_part", "_key", "term", "_tf", "_here", "_df"],
        )


def tf_idf(df: DataFrame, key: str, text: str, lengths: Sequence[int] = (1,)) -> DataFrame:
    """Term weight count * ln((N + 1) / (documents + 1)) per document and term.

    Terms are runs of as many words as ``lengths`` names: (1, 2) takes words and pairs of neighbours. Not the terms of the
    documents are shuffled but their texts, by a hash of the key into parts of about ``PART_CHARS`` characters, and for each
    part its distinct terms: to sum up their documents and, beside the texts once more, to bring back the sums of those that
    other parts have too. So a frequent term moves once per part. The words of a part are counted as numbers, not sorted as text.
    """
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length(text).cast("bigint") * len(lengths)).alias("chars")).first()
    n, parts = totals["n"], 1 + (totals["chars"] or 0) // PART_CHARS
    texts = df.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("_part"), F.col(key), F.col(text).alias("_text"))

    def counted(rows: DataFrame, by_key: bool) -> DataFrame:
        names = ["_part", key, "term", "_tf", "_here", "_df"] if by_key else ["_part", "term", "_df"]
        kinds = {"_part": IntegerType(), key: df.schema[key].dataType, "term": StringType()}
        schema = StructType([StructField(name, kinds.get(name, LongType())) for name in names])
        terms = F.when(F.col("_df").isNull(), F.coalesce(gram_terms(F.col("_text"), lengths), F.array())).otherwise(F.array("_text"))
        listed = rows.repartitionById(parts, F.col("_part")).select("_part", F.col(key), "_df", terms.alias("_terms"))
        return listed.mapInArrow(partial(count_terms, by_key=by_key), schema)

    fresh = texts.withColumn("_df", F.lit(None).cast("bigint"))
    held = counted(fresh, False)
    held = held.withColumn("_all", F.sum("_df").over(Window.partitionBy("term"))).where(F.col("_all") > F.col("_df"))
    held = held.select("_part", F.col("term").alias("_text"), F.col("_all").alias("_df"))
    both = counted(fresh.unionByName(held, allowMissingColumns=True), True).withColumn("_docs", F.coalesce("_df", "_here"))
    return both.select(key, "term", (F.col("_tf") * F.log(F.lit(float(n + 1)) / (F.col("_docs") + 1))).alias("weight"))


def top_terms(weights: DataFrame, key: str, k: int) -> DataFrame:
    """The k heaviest terms of each document, equal weights in term order."""
    order = Window.partitionBy(key).orderBy(F.desc("weight"), "term")
    ranked = weights.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def presence(df: DataFrame, key: str, text: str, positive: Column) -> tuple[DataFrame, float, float]:
    """(term, a, b): texts of the class and other texts that hold each term; then all texts and those of the class."""
    flagged = df.select(key, text, F.coalesce(positive, F.lit(False)).alias("_pos"))
    totals = flagged.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_pos").cast("bigint")).alias("p")).first()
    terms = flagged.select("_pos", F.explode(F.array_distinct(words(F.lower(text)))).alias("term"))
    counts = terms.groupBy("term").agg(
        F.sum(F.col("_pos").cast("double")).alias("a"), F.sum((~F.col("_pos")).cast("double")).alias("b")
    )
    return counts, float(totals["n"]), float(totals["p"] or 0)


def chi_square(df: DataFrame, key: str, text: str, positive: Column, min_documents: int = 1) -> DataFrame:
    """Chi-square of term presence against a yes/no class, from 2 x 2 counts."""
    counts, n, p = presence(df, key, text, positive)
    a, b = F.col("a"), F.col("b")
    c, d = F.lit(p) - a, F.lit(n - p) - b
    below = (a + b) * (c + d) * (a + c) * (b + d)
    value = F.lit(n) * (a * d - b * c) * (a * d - b * c) / F.nullif(below, F.lit(0.0))
    return counts.where(a + b >= min_documents).select(
        "term", (a + b).cast("bigint").alias("documents"), F.coalesce(value, F.lit(0.0)).alias("chi2")
    )


def mutual_information(df: DataFrame, key: str, text: str, positive: Column, min_documents: int = 1) -> DataFrame:
    """Mutual information (in nats) of term presence and a yes/no class; empty cells add nothing."""
    counts, n, p = presence(df, key, text, positive)
    a, b = F.col("a"), F.col("b")
    c, d = F.lit(p) - a, F.lit(n - p) - b

    def part(cell: Column, row: Column, column: float) -> Column:
        return F.when(cell > 0, cell / n * F.log(cell * n / (row * column))).otherwise(F.lit(0.0))

    value = part(a, a + b, p) + part(b, a + b, n - p) + part(c, c + d, p) + part(d, c + d, n - p)
    return counts.where(a + b >= min_documents).select("term", (a + b).cast("bigint").alias("documents"), value.alias("information"))
