"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed n-grams are compared: one of trusted texts, one of the
raw corpus. The n-grams are runs of ``GRAM`` bytes of the lower-cased words joined by
one blank, hashed to ``BUCKETS`` buckets. A document's verdict is the mean
log(p_trusted / p_raw) over its n-grams, against a threshold that is fixed once:
``MARGIN`` below the lowest of the trusted texts' ``KEEP`` best shares.

Corpus counts cover all documents, trusted counts and the threshold all texts that are
labelled good; the model has one number a bucket, however many those are. Without a
trusted text no verdict rejects.

Null, empty and blank texts have no words and fail the base rules (fewer than 50
words). Repeated rows are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.tables import arrow, hinted, written
from statloom.llm.words import SPACE, Words, chunked, grams
from statloom.operators.selection import quantiles

BITS = 15
BUCKETS = 1 << BITS
GRAM = 3
KEEP = 0.99
MARGIN = 0.1
SMOOTH = 1.0

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[first])


def repeat_words(hashes: np.ndarray, n: int = 3) -> int:
    """Words covered by an n-word window that the text holds twice or more."""
    _, which, times = np.unique(grams(hashes, n), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[which] > 1)
    covered = np.zeros(len(hashes), bool)
    for i in range(n):
        covered[starts + i] = True
    return int(covered.sum())


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """Per text: words, code points in words, symbols, repeated lines and words in repeated windows."""
    hashes = w.hashes()
    lead = (w.data & 0xC0) != 0x80
    total = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    chars = total[w.stops] - total[w.starts]
    repeats, lines = [], []
    for row, (lo, hi) in enumerate(zip(w.first[:-1], w.first[1:])):
        repeats.append(repeat_words(hashes[lo:hi]) if hi - lo > 3 else 0)
        with_words = [x for x in w.text(row).split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")] if hi > lo else []
        lines.append(len(with_words) - len(set(with_words)))
    return {
        "n_words": w.counts,
        "word_chars": sums(chars, w.first),
        "n_symbols": sums(SYMBOLS[w.data], w.bounds),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": np.array(repeats, np.int64),
    }


def row_buckets(w: Words) -> Iterator[np.ndarray]:
    """The bucket of every n-gram of each text."""
    inner = np.ones(len(w.starts), bool)
    inner[w.first[1:][w.counts > 0] - 1] = False
    keep = ~SPACE[w.data]
    keep[w.stops[inner]] = True
    kept = np.flatnonzero(keep)
    letters = np.where(SPACE[w.data[kept]], np.uint8(32), w.data[kept]).astype(np.uint32)
    bounds = np.searchsorted(kept, w.bounds)
    key = np.zeros(max(len(letters) - GRAM + 1, 0), np.uint32)
    for i in range(GRAM):
        key = (key << np.uint32(8)) | letters[i : i + len(key)]
    bucket = ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        yield bucket[lo : max(lo, hi - GRAM + 1)]


@dataclass(frozen=True)
class Model:
    """Log ratio of every bucket, and the least mean ratio that is kept."""

    ratio: np.ndarray
    threshold: float

    def scores(self, w: Words) -> np.ndarray:
        return np.array([float(self.ratio[b].mean()) if len(b) else 0.0 for b in row_buckets(w)])


def count_grams(docs: DataFrame) -> np.ndarray:
    """Occurrences of every bucket over all texts of a table with a column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, w in chunked(batch["text"], fold=True):
                for b in row_buckets(w):
                    total += np.bincount(b, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    parts = arrow(docs.select("text"), count, "bucket int, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of all rows that are labelled good."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.select("doc_id", "text").join(hinted(written(good)), "doc_id").select("text")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    good = trusted_texts(docs, labels)
    trusted, raw = count_grams(good), count_grams(docs)
    if not trusted.sum():
        return Model(np.zeros(BUCKETS), -np.inf)
    share = lambda n: (n + SMOOTH) / (n.sum() + SMOOTH * BUCKETS)
    ratio = np.log(share(trusted) / share(raw))
    least = quantiles(written(score(good, Model(ratio, 0.0))), ["score"], [1 - KEEP]).first()["q"][0]
    return Model(ratio, least - MARGIN)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Mean log ratio of every text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [held.value.scores(w) for _, w in chunked(batch["text"], fold=True)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts))], names=["score"])

    return arrow(docs.select("text"), run, "score double")


def verdicts(text: pa.Array, model: Model) -> dict[str, np.ndarray]:
    """Base counts, base_failed, score and kept of every text."""
    parts = [base_counts(w) for _, w in chunked(text)]
    out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["score"] = np.concatenate([model.scores(w) for _, w in chunked(text, fold=True)])
    out["kept"] = ~out["base_failed"] & (out["score"] >= model.threshold)
    return out


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = verdicts(batch["text"], held.value)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(v) for v in found.values()]], names=["doc_id", *found])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, {COUNTS}, base_failed boolean, score double, kept boolean")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are kept, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(verdicts(batch["text"], held.value)["kept"]))

    return arrow(docs, run, docs.schema)
