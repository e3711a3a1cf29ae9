"""Removal of word passages that an earlier document holds.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window that
covers it also starts in a document with a smaller doc_id; windows are judged on
the input, not on what is left.

1. Equal texts are one text with the least doc_id of its rows; a row with a larger one loses all its windows at once.
2. Each window is named by its minimizer, the least hash among its runs of ``SEED`` words. Equal windows have equal
   minimizers, and neighbouring windows mostly share one, so a text has about two in seven words.
   Minimizers that two texts hold are kept, with their text.
3. Each text meets its kept minimizers; the windows they name are hashed whole and meet by that hash. The least doc_id of each is
   found, and the windows of later texts become spans.
4. Every row is read once more and its words outside of the spans are kept.

Frequent minimizers and windows are settled inside a task's chunk of texts: what two texts of a chunk share needs no
vote, and each chunk sends at most two rows for a minimizer, and one text's rows for a window, to the shuffle. So a passage that
a third of all documents hold arrives as often as there are chunks, not documents. Rows settled in this way ride along
under keys of their own.

Memory is bounded by a chunk and by the longest text. Null, empty and blank texts have no words. Repeated rows, having one doc_id, do not
remove each other. Rows without doc_id neither lose words nor remove any. Equal windows are found by
64-bit hashes next to the minimizer's, equal texts by 128 bits. An empty table gives an empty result. Only doc_id and
text are read and returned, so names never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.tables import arrow, written
from statloom.llm.words import chunked, grams, join

WINDOW = 13
SEED = 8
CHUNK_BYTES = 4 << 20
"""Text whose shared passages are settled at once in a task."""

BROADCAST_BYTES = 64 << 20
"""Most bytes of spans that are broadcast for the last pass."""


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    total, size, out = len(values) - width + 1, 1, values
    if total <= 0:
        return values[:0]
    while 2 * size <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return np.minimum(out[:total], out[width - size : width - size + total])


def minimizers(hashes: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The minimizer of each window."""
    return sliding_least(grams(hashes, seed), window - seed + 1)


def light(df: DataFrame, *lists: str) -> DataFrame:
    """Broadcast a written table if its numbers take few enough bytes; beyond, Spark shuffles."""
    held = df.agg(F.sum(8 * sum((F.greatest(F.size(c), F.lit(0)) for c in lists), F.lit(12)))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def changes(*columns: np.ndarray) -> np.ndarray:
    """Of rows sorted by some columns: where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, in order."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    cut = np.flatnonzero(starts[1:] > stops[:-1])
    return starts[np.concatenate([[0], cut + 1])], stops[np.concatenate([cut, [len(stops) - 1]])]


def laid(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lists end to end, and the number of the list that each value is from."""
    return np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def chunk_seeds(digests: np.ndarray, seeds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, digest, minimizer, votes) of what the texts of a chunk send to the vote, one row for each minimizer and text.

    A minimizer votes under its own key. Where more than two texts of the chunk hold it, two vote; for the others it is kept
    already, and goes under a key that no other row has.
    """
    seed, text = laid(seeds)
    digest = digests[text]
    order = np.lexsort((digest, seed))
    seed, digest = seed[order], digest[order]
    once = changes(seed, digest)
    seed, digest = seed[once], digest[once]
    new = changes(seed)
    votes = new | np.append(new[1:], True)
    return np.where(votes, seed, join(seed, digest.view(np.uint64))), digest, seed, votes


def chunk_windows(ranks: np.ndarray, hashes: list[np.ndarray], places: list[np.ndarray], window: int) -> Iterator[tuple]:
    """(key, text, start, stop, further starts, late) of the windows of a chunk, columns as arrays.

    A window that a text of less rank in the chunk holds is late; late windows go as merged spans under keys that no other row has.
    The others go once for each text, further places of the same window as a list.
    """
    (value, text), at = laid(hashes), np.concatenate(places).astype(np.int64)
    order = np.lexsort((at, text, ranks[text], value))
    value, text, at = value[order], text[order], at[order]
    new = changes(value)
    late = ranks[text] > ranks[text[np.flatnonzero(new)]][np.cumsum(new) - 1]
    if late.any():
        room = int(at.max()) + 2 * window
        start, stop = merged(text[late] * room + at[late], text[late] * room + at[late] + window)
        whose = start // room
        own = join(start.astype(np.uint64), np.full(len(start), value[0]))
        yield own, whose, start - whose * room, stop - whose * room, (np.zeros(0, np.int64), np.zeros(len(start) + 1, np.int64)), True
    value, text, at = value[~late], text[~late], at[~late]
    if len(value):
        new = changes(value, text)
        first = np.flatnonzero(new)
        ends = np.concatenate([[0], np.cumsum(np.diff(np.append(first, len(value))) - 1)])
        yield value[new], text[new], at[new], at[new] + window, (at[~new], ends), False


def name_texts(window: int, seed: int, most: int):
    """Arrow rows (key, digest, minimizer) of texts; the minimizer is null in a vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch["digest"].to_numpy(zero_copy_only=False)
            for row, w in chunked(batch["text"], most=most):
                hashes = w.hashes()
                found = [np.unique(minimizers(hashes[lo:hi], window, seed)) for lo, hi in zip(w.first[:-1], w.first[1:])]
                if sum(map(len, found)):
                    key, digest, real, votes = chunk_seeds(digests[row : row + len(found)], found)
                    arrays = [pa.array(key.view(np.int64)), pa.array(digest), pa.array(real.view(np.int64), mask=votes)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "digest", "seed"])

    return run


def name_windows(window: int, seed: int, most: int):
    """Arrow rows (key, first, digest, start, stop, more, late) of the windows that kept minimizers name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, docs = batch["seeds"], batch["first"]
            for row, w in chunked(batch["text"], most=most):
                hashes, found, places = w.hashes(), [], []
                for i, (lo, hi) in enumerate(zip(w.first[:-1], w.first[1:])):
                    mine, shared = hashes[lo:hi], kept[row + i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    at = np.flatnonzero(np.isin(minimizers(mine, window, seed), shared))
                    found.append(grams(mine, window)[at])
                    places.append(at)
                if not sum(map(len, found)):
                    continue
                own = docs.slice(row, len(found))
                ranks = pc.rank(own, tiebreaker="dense").to_numpy().astype(np.int64)
                digests = batch["digest"].slice(row, len(found))
                for key, text, start, stop, (more, ends), late in chunk_windows(ranks, found, places, window):
                    pick = pa.array(text)
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(more, pa.int32()))
                    numbers = [pa.array(x, pa.int32()) for x in (start, stop)]
                    arrays = [pa.array(key.view(np.int64)), own.take(pick), digests.take(pick), *numbers, lists, pa.array([late] * len(key))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "first", "digest", "start", "stop", "more", "late"])

    return run


def merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, digest, starts, stops): the spans of each text, merged."""
    for batch in batches:
        pairs = []
        for spans in batch["spans"]:
            fields = spans.values
            pairs.append(merged(*(fields.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))))
        lists = [pa.array([p[i] for p in pairs], pa.list_(pa.int32())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch["first"], batch["digest"], *lists], names=["first", "digest", "starts", "stops"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text of the rows that take part, with the text's hashes."""
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return rows.withColumns({"digest": F.xxhash64("text"), "check": F.xxhash64(F.lit(1), "text")})


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(digest, check, first, starts, stops), written: of each text that rows with several doc_ids hold, or words of which go, the least
    doc_id and the word spans that go there."""
    kind, docs = docs.schema["doc_id"].dataType.simpleString(), keyed(docs)
    texts = written(docs.groupBy("digest", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))

    votes = arrow(docs.select("digest", "text"), name_texts(window, seed, chunk), "key long, digest long, seed long")
    among = Window.partitionBy("key")
    votes = votes.withColumns({"low": F.min("digest").over(among), "high": F.max("digest").over(among)})
    kept = votes.filter("low < high OR seed IS NOT NULL").groupBy("digest").agg(F.collect_set(F.coalesce("seed", "key")).alias("seeds"))
    kept = written(kept.join(texts.select("digest", "check", "first"), "digest"))

    own = docs.select("digest", "check", F.col("doc_id").alias("first"), "text").join(kept, ["digest", "check", "first"])
    windows = arrow(own.select("digest", "first", "text", "seeds"), name_windows(window, seed, chunk), f"key long, first {kind}, digest long, start int, stop int, more array<int>, late boolean")
    late = windows.withColumn("least", F.min("first").over(among)).filter("late OR first > least")
    span = lambda start, stop: F.struct(start.alias("start"), stop.alias("stop"))
    every = F.concat(F.array(span(F.col("start"), F.col("stop"))), F.transform("more", lambda p: span(p, p + window)))
    late = late.groupBy("first", "digest").agg(F.flatten(F.collect_list(every)).alias("spans"))
    found = arrow(late, merge_spans, f"first {kind}, digest long, starts array<int>, stops array<int>")
    joined = texts.join(found, ["digest", "first"], "left").filter("first < last OR starts IS NOT NULL")
    return written(joined.select("digest", "check", "first", "starts", "stops"))


def cleaned(docs: DataFrame, window: int = WINDOW, seed: int = SEED, chunk: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (words joined by one blank) of every row."""
    kind, found = docs.schema["doc_id"].dataType.simpleString(), light(repeats(docs, window, seed, chunk), "starts", "stops")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, copy, starts, stops in zip(*[batch[c] for c in ("text", "copy", "starts", "stops")]):
                words = (text.as_py() or "").encode().split()
                counts.append(len(words))
                if copy.as_py() and len(words) >= window:
                    words = []
                elif starts.is_valid:
                    gone = list(zip(starts.as_py(), stops.as_py()))
                    edges = [0, *[x for span in gone for x in span], len(words)]
                    words = [w for lo, hi in zip(edges[::2], edges[1::2]) for w in words[lo:hi]]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode())
            arrays = [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept"])

    rows = docs.select("doc_id", "text").withColumns({"digest": F.xxhash64("text"), "check": F.xxhash64(F.lit(1), "text")})
    rows = rows.join(found, ["digest", "check"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    keep = F.col("doc_id") == F.col("first")
    spans = {c: F.when(keep, F.col(c)) for c in ("starts", "stops")}
    return arrow(rows.withColumns(spans).select("doc_id", "text", "copy", "starts", "stops"), cut, f"doc_id {kind}, n_words long, n_removed long, kept string")
