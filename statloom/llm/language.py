"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs, made from its code point alone. An
n-gram of letters (lower-cased; all else is one blank) binds its letters' vectors by
multiplication, each rolled by its place. A text's vector bundles (adds) the vectors of all its
n-grams; a language's prototype bundles those of its training texts, each text scaled to
length 1, less the mean of all prototypes. The text takes the language of the largest cosine,
the first by name on ties; the score is the softmax of the cosines, sharpened by ``SHARP``.

Training takes at most ``TRAINING`` texts of a language, those with the lowest hash of (id, text), so no language is left out;
repeated rows train once. Texts that are null or without a letter are ``und`` with score 0. With nothing learned
every text is ``und``. Repeated rows are predicted alike. Further columns of any name take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.tables import arrow, hinted, written
from statloom.llm.words import mix

DIMENSIONS = 1024
GRAM = 3
TRAINING = 500
SHARP = 20.0
BLOCK_LETTERS = 1 << 18
"""Letters that are counted together."""

_LETTER: np.ndarray | None = None


def is_letter() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTER


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; 32 for every run of other signs, also at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = is_letter()[np.minimum(codes, 0x10FFFF)]
    codes = np.concatenate([[np.uint32(32)], np.where(known, codes, np.uint32(32)), [np.uint32(32)]])
    blank = codes == 32
    return codes[~(blank & np.concatenate([[False], blank[:-1]]))]


def keys(codes: np.ndarray) -> np.ndarray:
    """Every n-gram as one number of 21 bits a letter."""
    out = np.zeros(max(len(codes) - GRAM + 1, 0), np.uint64)
    for i in range(GRAM):
        out = out << np.uint64(21) | codes[i : i + len(out)].astype(np.uint64)
    return out


def signs(codes: np.ndarray) -> np.ndarray:
    """The random vector of each letter, a row of +1 and -1."""
    seeds = codes.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS // 64) + np.arange(DIMENSIONS // 64, dtype=np.uint64)
    bits = np.unpackbits(mix(mix(seeds)).view(np.uint8), axis=1)
    return np.where(bits, np.float32(1), np.float32(-1))


def bound(grams: np.ndarray) -> np.ndarray:
    """The bound vector of every n-gram."""
    out = None
    for place in range(GRAM):
        code = grams >> np.uint64(21 * (GRAM - 1 - place)) & np.uint64((1 << 21) - 1)
        unique, at = np.unique(code, return_inverse=True)
        part = np.roll(signs(unique), GRAM - 1 - place, axis=1)[at]
        out = part if out is None else out * part
    return out


class Space:
    """Vectors of n-grams met so far, at most ``most``."""

    def __init__(self, most: int = 20_000):
        self.most = most
        self.known = np.zeros(0, np.uint64)
        self.rows = np.zeros((0, DIMENSIONS), np.float32)

    def of(self, grams: np.ndarray) -> np.ndarray:
        new = np.setdiff1d(grams, self.known, assume_unique=True)
        if len(new):
            if len(self.known) + len(new) > self.most:
                self.known, self.rows, new = self.known[:0], self.rows[:0], grams
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.rows = known[order], np.concatenate([self.rows, bound(new)])[order]
        return self.rows[np.searchsorted(self.known, grams)]


def vectors(texts: list[str | None], space: Space) -> np.ndarray:
    """The bundle of each text scaled to length 1; zeros without a letter."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    row = 0
    while row < len(texts):
        block, held, start = [], 0, row
        while row < len(texts) and (not block or held < BLOCK_LETTERS):
            block.append(keys(letters(texts[row])) if texts[row] else np.zeros(0, np.uint64))
            held += len(block[-1])
            row += 1
        grams, at = np.unique(np.concatenate(block), return_inverse=True)
        if len(grams):
            owner = np.repeat(np.arange(len(block)), [len(b) for b in block])
            counts = np.bincount(owner * len(grams) + at, minlength=len(block) * len(grams)).reshape(len(block), -1)
            for lo in range(0, len(grams), 8_192):
                out[start:row] += counts[:, lo : lo + 8_192].astype(np.float32) @ space.of(grams[lo : lo + 8_192])
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def train(labelled: DataFrame, most: int = TRAINING) -> tuple[list[str], np.ndarray]:
    """Names of the languages, sorted, and their prototypes, from rows (doc_id, text, lang)."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang").withColumn("h", F.xxhash64("doc_id", "text"))
    each = written(rows.select("lang", "h").distinct())
    counts = hinted(written(each.groupBy("lang").agg(F.count("*").alias("of"))))
    # Hashes are even: a bound on them leaves about twice the texts wanted, and only those are ranked.
    low = each.join(counts, "lang").filter(F.shiftrightunsigned("h", 11) / float(1 << 53) * F.col("of") <= 2 * most)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    drawn = written(low.withColumn("nth", nth).filter(F.col("nth") <= most).select("lang", "h"))
    few = rows.join(hinted(drawn), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(), {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for lang, v in zip(langs, vectors(batch["text"].to_pylist(), space)):
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        rows = [(k, i, float(x)) for k, v in sums.items() for i, x in enumerate(v)]
        if rows:
            lang, place, value = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(place, pa.int32()), pa.array(value)], names=["lang", "place", "value"])

    found = arrow(few, run, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value")).toPandas()
    if not len(found):
        return [], np.zeros((0, DIMENSIONS), np.float32)
    table = found.pivot(index="lang", columns="place", values="value").sort_index()
    return scaled(list(table.index), table.to_numpy(np.float64))


def scaled(names: list[str], sums: np.ndarray) -> tuple[list[str], np.ndarray]:
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    names = [n for n, x in zip(names, length[:, 0]) if x > 0]
    unit = (sums / np.where(length > 0, length, 1))[length[:, 0] > 0]
    if len(unit) > 1:
        unit = unit - unit.mean(axis=0)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    return names, unit.astype(np.float32)


def choose(texts: list[str | None], names: list[str], prototypes: np.ndarray, space: Space) -> tuple[list[str], np.ndarray]:
    v = vectors(texts, space)
    spoken = np.array([bool(t) and bool(is_letter()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()) for t in texts], bool)
    if not names:
        return ["und"] * len(texts), np.zeros(len(texts))
    cosine = (v @ prototypes.T).astype(np.float64)
    power = np.exp(SHARP * (cosine - cosine.max(axis=1, keepdims=True)))
    best = cosine.argmax(axis=1)
    score = power[np.arange(len(texts)), best] / power.sum(axis=1)
    return [names[b] if s else "und" for b, s in zip(best, spoken)], np.where(spoken, score, 0.0)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast((names, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lang, score = choose(part["text"].to_pylist(), *held.value, space)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")
