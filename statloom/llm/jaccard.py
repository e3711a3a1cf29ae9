"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups it links.

A document's set holds its distinct shingles (hashes of ``SIZE`` words, A to Z
lower-cased; a shorter text is one shingle). Two documents link when
100 * |x & y| >= percent * |x | y|.

1. Estimates. On one document in ``SAMPLE`` the frequency of every shingle is counted; the
   ``KNOWN`` most frequent ones make a table of fixed size. It only steers the cost: order
   and prefix length. Every document is indexed and every candidate verified.
2. Index. All sets are ordered alike, frequent shingles last. With o = ceil(percent * |x| / 100),
   linked sets share at least m of their first |x| - o + m shingles. Each document picks its
   own m: a longer prefix costs more postings but asks for m shared ones, so that
   the expected number of candidates, frequency over m, falls. A pair must share the
   smaller m of the two, within the prefixes that follow from both sizes: there o is
   the overlap that this pair needs. Every class also carries ``BITS`` parities of its hashes;
   where two differ in d of them, at least d shingles are in one set only, and pairs
   with too many of those never leave the join (sets much longer than ``BITS`` pass).
3. Documents of equal sets are one class, named by a 64-bit hash of the set.
4. Stars. Each posting list links its classes to one centre, the class that holds the shingle
   at the earliest place, and so has the fewest rare ones; verified exactly. The groups
   found contract, so that large groups of near copies never become all their pairs.
5. Rest. Posting lists that still hold several groups give pairs between different
   groups only; those that share enough and fit in size are verified.

Both verified steps give exact links, and no pair of different groups is left out, so
the components are those of all links. Null, empty and blank texts link with
nothing. Rows without doc_id have no component (null) and link nothing. Repeated
rows are equal sets. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.graph import components
from statloom.llm.tables import arrow, hinted, written
from statloom.llm.words import Words, chunked, grams, whole

SIZE = 4
PERCENT = 85
SAMPLE = 8
KNOWN = 1 << 17
RARE = 4
"""Fewer sampled documents than this do not make a shingle frequent."""
DEEPEST = 6
"""Most shared prefix shingles that a document may ask for."""
BITS = 256
"""Parities that are kept of a set."""
VERIFY = 20.0
"""Cost of a candidate, in postings."""
TOGETHER = 1_000
"""Members that are compared with one copy of their centre."""


def sets(w: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes = w.hashes()
    runs = grams(hashes, size)
    for lo, hi in zip(w.first[:-1], w.first[1:]):
        if hi - lo >= size:
            yield np.unique(runs[lo : hi - size + 1])
        else:
            yield np.array([whole(hashes[lo:hi])], np.uint64) if hi > lo else runs[:0]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def named(shingles: np.ndarray) -> int:
    """The class of a set."""
    return int(np.array(xxhash.xxh3_64_intdigest(shingles.tobytes()), np.uint64).view(np.int64))


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the hashes in each of ``BITS`` classes are odd in number, as longs of 64 bits."""
    odd = np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def frequent(docs: DataFrame, size: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles and their estimated frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w in chunked(batch["text"], fold=True):
                found = np.concatenate([*sets(w, size)])
                yield pa.RecordBatch.from_arrays([pa.array(signed(found))], names=["token"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0).select("text")
    counts = arrow(some, run, "token long").groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= RARE)
    top = counts.orderBy(F.desc("n"), "token").limit(KNOWN).toArrow()
    tokens, n = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy() * float(sample)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def prefix(shingles: np.ndarray, tokens: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The postings of a set, and how many of them a partner must share."""
    n = len(shingles)
    need = -(-percent * n // 100)
    freq = np.zeros(n)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, shingles), len(tokens) - 1)
        freq = np.where(tokens[at] == shingles, often[at], 0.0)
    order = np.lexsort((shingles, freq))
    depth = np.arange(1, min(DEEPEST, need) + 1)
    seen = np.cumsum(freq[order])[n - need + depth - 1]
    best = int(np.argmin(seen * (1 + VERIFY / depth)))
    return shingles[order[: n - need + best + 1]], best + 1


def index(docs: DataFrame, size: int, percent: int, tokens: np.ndarray, often: np.ndarray) -> DataFrame:
    """(doc_id, n, cls, deep, bits, prefix) of every row."""
    held = docs.sparkSession.sparkContext.broadcast((tokens, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, w in chunked(batch["text"], fold=True):
                out = []
                for x in sets(w, size):
                    first, deep = prefix(x, *held.value, percent) if len(x) else (x, 0)
                    out.append((len(x), named(x) if len(x) else None, deep, parities(x), signed(first)))
                n, cls, deep, bits, firsts = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(row, len(out)),
                        pa.array(n, pa.int64()),
                        pa.array(cls, pa.int64()),
                        pa.array(deep, pa.int32()),
                        pa.array(bits, pa.list_(pa.int64())),
                        pa.array(firsts, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "cls", "deep", "bits", "prefix"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n long, cls long, deep int, bits array<long>, prefix array<long>")


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets link; the sets are made again from one document each."""
    load = pairs.groupBy("a").agg(F.count("*").alias("load"))
    parts = F.ceil(F.col("load") / TOGETHER).cast("int")
    centres = load.select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("cls"))
    spread = pairs.join(load, "a").select("a", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("cls"))
    tasks = written(centres.union(spread).join(reps, "cls"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            made = (x for _, w in chunked(batch["text"], fold=True) for x in sets(w, size))
            for a, role, cls, x in zip(*[batch[c].to_pylist() for c in ("a", "role", "cls")], made):
                if role == 0:
                    centre, own = a, x
                elif centre == a:
                    both = len(np.intersect1d(own, x, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(x) - both):
                        left.append(a)
                        right.append(cls)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    texts = docs.select("doc_id", "text").join(hinted(tasks), "doc_id").select("text", "a", "part", "role", "cls")
    dealt = texts.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return arrow(dealt, compare, "a long, b long").distinct()


def links(docs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links between classes that give the components of all links."""
    filled = rows.filter("cls IS NOT NULL AND doc_id IS NOT NULL")
    same = [F.first(c).alias(c) for c in ("n", "deep", "bits")]
    classes = written(filled.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), *same))
    narrow, reps = classes.select("cls", "n", "deep", "bits"), classes.select("cls", "doc_id")
    postings = filled.select("cls", "prefix").dropDuplicates(["cls"]).select("cls", F.posexplode("prefix").alias("pos", "token"))
    postings = postings.filter("token IS NOT NULL").repartition("token")
    centre = F.min(F.struct("pos", "cls"))
    lists = postings.groupBy("token").agg(F.count("*").alias("held"), centre.alias("centre")).filter("held > 1")
    shared = written(postings.join(lists.select("token", "centre"), "token"))

    # Where the first postings that others share stand in each class: all that can count towards deep.
    spots = shared.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("pos")), 1, DEEPEST).alias("spots"))
    narrow = written(narrow.join(spots, "cls"))

    def close(a: dict[str, Column], b: dict[str, Column]) -> Column:
        """Whether sizes and parities fit, and a shared posting lies in the prefixes that this very pair asks for, which can hold enough."""
        deep = F.least(a["deep"], b["deep"])
        need = F.ceil(percent * (a["n"] + b["n"]) / (100 + percent))
        more = deep - need
        apart = sum(F.bit_count(F.get(a["bits"], F.lit(i)).bitwiseXOR(F.get(b["bits"], F.lit(i)))) for i in range(BITS // 64))
        fits = a["n"] + b["n"] - apart >= 2 * need
        fits &= 100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])
        for x in (a, b):
            fits &= (x["pos"] < x["n"] + more) & (F.get(x["spots"], deep - 1) < x["n"] + more)
        return fits

    def enough(pairs: DataFrame) -> DataFrame:
        counted = pairs.groupBy("a", "b", "deep").agg(F.count("*").alias("hits"))
        return counted.filter("hits >= deep").select("a", "b")

    sides = {k: narrow.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("deep").alias(f"deep{k}"), F.col("spots").alias(f"spots{k}"), F.col("bits").alias(f"bits{k}")) for k in "ab"}
    here = {k: {c: F.col(f"{c}{k}") for c in ("n", "deep", "pos", "spots", "bits")} for k in "ab"}
    least = F.least("deepa", "deepb").alias("deep")
    stars = shared.filter("cls != centre.cls").select(F.col("centre.cls").alias("a"), F.col("centre.pos").alias("posa"), F.col("cls").alias("b"), F.col("pos").alias("posb"))
    stars = written(enough(stars.join(sides["a"], "a").join(sides["b"], "b").filter(close(here["a"], here["b"])).select("a", "b", least)))
    found = written(verified(docs, reps, stars, size, percent))

    groups = components(found).withColumnRenamed("v", "cls")
    tagged = shared.select("token", "cls", "pos").join(groups, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    tagged = tagged.join(narrow, "cls").repartition("token")
    mixed = tagged.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    mixed = written(tagged.join(mixed.select("token"), "token"))
    x, y = (mixed.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("cls", "label", "n", "deep", "pos", "spots", "bits")]) for k in "ab")
    apart = (F.col("labela") != F.col("labelb")) & (F.col("clsa") < F.col("clsb"))
    rest = x.join(y, (x["token"] == y["token"]) & apart & close(here["a"], here["b"]))
    rest = enough(rest.select(F.col("clsa").alias("a"), F.col("clsb").alias("b"), least))
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(rest.join(tried, ["a", "b"], "left_anti"))
    return found.union(verified(docs, reps, rest, size, percent)) if not rest.isEmpty() else found


def grouped(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of the group) of every row."""
    rows = written(index(docs, size, percent, *frequent(docs, size, sample)))
    labels = components(links(docs, rows, size, percent)).withColumnRenamed("v", "cls")
    filled = rows.filter("cls IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n", "cls")
    marked = filled.join(labels, "cls", "left").select("doc_id", "n", F.coalesce("label", "cls").alias("label"))
    least = marked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    held = marked.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter("cls IS NULL OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return held.union(alone)


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The row of the least doc_id of every group, with all its columns; rows without doc_id stay.

    Of rows that share a doc_id one stays.
    """
    found = written(grouped(docs, size, percent))
    gone = written(found.filter("doc_id != component_id").select("doc_id").distinct())
    kept = docs.join(hinted(gone), "doc_id", "left_anti").select(*[docs[c] for c in docs.columns])
    twice = written(found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    again = kept.join(hinted(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(hinted(twice), "doc_id", "left_anti").select(*kept.columns).union(again.select(*kept.columns))
