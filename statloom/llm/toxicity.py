"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word, a run of letters and digits, enters as the sum of its own embedding, if at least ``COMMON``
training texts hold it (else that of all rare words), and the mean embedding of its hashed byte
trigrams. The first number of a word's embedding starts at half the z-score of its count of toxic
training texts. Windows of ``WINDOW`` words, one every ``STEP`` words, run through a gated
recurrent layer in both directions; attention pools a window's states into one logit. A text
scores the logistic of its largest logit: all overlapping windows of the whole text count.

The network is trained here, in numpy, on at most ``TRAINING`` labelled texts of each label
with at most ``TRAINING_CHARS`` characters, those with the lowest hash of their id. A text's label
is put on its window with the largest logit, found anew in each epoch.

Null, empty and blank texts have no window and score 0. With no training text of either label
every score is 0. Repeated rows score alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.tables import arrow
from statloom.llm.words import SPACE, Words, chunked, mix

WINDOW, STEP = 24, 12
CHAR_ROWS = 1 << 12
COMMON, VOCABULARY = 5, 20_000
WIDTH, HIDDEN = 12, 8
TRAINING, TRAINING_CHARS = 1_200, 20_000
EPOCHS, BATCH, RATE = 14, 64, 0.01

APART = SPACE.copy()
APART[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True
"""ASCII signs that are neither letters nor digits part words."""

Net = dict[str, np.ndarray]


def new_net(known: np.ndarray, seed: int = 7) -> Net:
    """``known``: sorted hashes of the words that have an embedding of their own."""
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    net = {"known": known, "word": draw(0.1, len(known) + 1, WIDTH), "char": draw(0.2, CHAR_ROWS, WIDTH)}
    for d in "fb":
        net[f"x{d}"], net[f"u{d}"] = draw(0.3, WIDTH, 3 * HIDDEN), draw(0.3, HIDDEN, 3 * HIDDEN)
        net[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)
    net["key"], net["query"] = draw(0.3, 2 * HIDDEN, HIDDEN), draw(0.3, HIDDEN)
    net["out"], net["bias"] = draw(0.3, 2 * HIDDEN), np.full(1, -1.0, np.float32)
    return net


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Text:
    """Distinct words of a chunk: word row, trigram rows and their bounds; and the word numbers of its windows."""

    def __init__(self, w: Words, known: np.ndarray):
        hashes = w.hashes()
        names, first, self.words = np.unique(hashes, return_index=True, return_inverse=True)
        self.row = np.zeros(len(names), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, names), len(known) - 1)
            self.row = np.where(known[at] == names, at + 1, 0)
        start, size = w.starts[first], (w.stops - w.starts)[first]
        self.edge = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(start - self.edge[:-1], size) + np.arange(self.edge[-1])
        here = w.data[at].astype(np.uint64)
        before, after = np.concatenate([[0], here[:-1]]).astype(np.uint64), np.concatenate([here[1:], [0]]).astype(np.uint64)
        if len(here):
            before[self.edge[:-1]] = 0
            after[self.edge[1:] - 1] = 0
        self.tri = (mix(here | before << np.uint64(8) | after << np.uint64(16)) % np.uint64(CHAR_ROWS)).astype(np.int64)
        counts = w.counts
        many = np.where(counts > 0, np.maximum(0, -(-(counts - WINDOW) // STEP)) + 1, 0)
        self.owner = np.repeat(np.arange(len(counts)), many)
        begin = np.concatenate([[0], np.cumsum(many)])
        self.bounds = begin
        nth = np.arange(begin[-1]) - begin[self.owner]
        place = w.first[self.owner] + STEP * nth
        spots = place[:, None] + np.arange(WINDOW)
        self.real = spots < w.first[self.owner + 1][:, None]
        self.index = self.words[np.minimum(spots, max(len(self.words) - 1, 0))] if len(self.words) else spots

    def inputs(self, net: Net) -> np.ndarray:
        """The vector of every distinct word."""
        if not len(self.row):
            return np.zeros((0, WIDTH), np.float32)
        chars = np.add.reduceat(net["char"][self.tri], self.edge[:-1], axis=0)
        return net["word"][self.row] + chars / np.diff(self.edge)[:, None].astype(np.float32)


def recur(projected: np.ndarray, index: np.ndarray, real: np.ndarray, u: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States (window, place, HIDDEN) of one direction; ``keep`` gets what the gradient needs."""
    n, length = index.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states = np.empty((length, n, HIDDEN), np.float32)
    for t in range(length - 1, -1, -1) if back else range(length):
        x, own = projected[index[:, t]], h @ u
        gate = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])))
        z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + r * own[:, 2 * HIDDEN :])
        m = real[:, t, None]
        if keep is not None:
            keep.append((t, h, z, r, new, own[:, 2 * HIDDEN :], m))
        h = np.where(m, new + z * (h - new), h)
        states[t] = h
    return states


def attend(net: Net, states: np.ndarray, real: np.ndarray):
    """Logits of windows from states (place, window, 2 * HIDDEN)."""
    hidden = np.tanh(states @ net["key"])
    energy = np.where(real.T, hidden @ net["query"], np.float32(-1e9))
    weight = np.exp(energy - energy.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    return pooled @ net["out"] + net["bias"][0], hidden, weight, pooled


def logits(net: Net, t: Text) -> np.ndarray:
    """One logit for each window of the chunk."""
    if not len(t.index):
        return np.zeros(0, np.float32)
    x = t.inputs(net)
    both = [recur(x @ net[f"x{d}"] + net[f"c{d}"], t.index, t.real, net[f"u{d}"], d == "b") for d in "fb"]
    return attend(net, np.concatenate(both, axis=2), t.real)[0]


def gradient(net: Net, t: Text, picks: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Net:
    """Gradient of the weighted logistic loss of chosen windows."""
    index, real, x = t.index[picks], t.real[picks], t.inputs(net)
    kept: dict[str, list] = {"f": [], "b": []}
    both = [recur(x @ net[f"x{d}"] + net[f"c{d}"], index, real, net[f"u{d}"], d == "b", kept[d]) for d in "fb"]
    states = np.concatenate(both, axis=2)
    logit, hidden, weight, pooled = attend(net, states, real)
    out: Net = {}
    d_logit = ((logistic(logit) - labels) * weights / weights.sum()).astype(np.float32)
    out["bias"], out["out"] = d_logit.sum(keepdims=True), pooled.T @ d_logit
    d_pooled = d_logit[:, None] * net["out"]
    d_weight = (states * d_pooled).sum(axis=2)
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_hidden = d_energy[:, :, None] * net["query"] * (1 - hidden**2)
    out["query"] = np.einsum("tn,tnh->h", d_energy, hidden)
    out["key"] = np.einsum("tns,tnh->sh", states, d_hidden)
    d_states = weight[:, :, None] * d_pooled + d_hidden @ net["key"].T
    d_x = np.zeros_like(x)
    for d, part in (("f", d_states[:, :, :HIDDEN]), ("b", d_states[:, :, HIDDEN:])):
        u, carry = net[f"u{d}"], np.zeros((len(picks), HIDDEN), np.float32)
        d_u, d_projected = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32)
        for place, h, z, r, new, own, m in reversed(kept[d]):
            d_h = carry + part[place]
            live = np.where(m, d_h, 0)
            d_new = live * (1 - z) * (1 - new**2)
            d_z, d_r = live * (h - new) * z * (1 - z), d_new * own * r * (1 - r)
            d_own = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_u += h.T @ d_own
            np.add.at(d_projected, index[:, place], np.concatenate([d_z, d_r, d_new], axis=1))
            carry = np.where(m, live * z, d_h) + d_own @ u.T
        out[f"u{d}"], out[f"c{d}"], out[f"x{d}"] = d_u, d_projected.sum(axis=0), x.T @ d_projected
        d_x += d_projected @ net[f"x{d}"].T
    used = np.flatnonzero(np.abs(d_x).sum(axis=1))
    out["word"], out["char"] = np.zeros_like(net["word"]), np.zeros_like(net["char"])
    np.add.at(out["word"], t.row[used], d_x[used])
    size = np.diff(t.edge)
    spread = np.repeat(d_x / size[:, None].astype(np.float32), size, axis=0)
    hit = np.repeat(np.isin(np.arange(len(size)), used), size)
    np.add.at(out["char"], t.tri[hit], spread[hit])
    return out


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> Net:
    """Adam on the strongest window of each text."""
    rng = np.random.default_rng(11)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    held, parts = [], []
    for lo in range(0, len(texts), BATCH):
        hi = min(lo + BATCH, len(texts))
        data = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        held.append((Words(data, bounds[lo : hi + 1] - bounds[lo], True, APART), labels[lo:hi]))
        hashes, first = held[-1][0].hashes(), held[-1][0].first
        parts += [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]
    names, which, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
    toxic = np.bincount(which, np.repeat(labels, [len(x) for x in parts]), len(names))
    surprise = np.clip((toxic - counts * share) / np.sqrt(counts * share * (1 - share)), -4, 4) / 2
    order = np.lexsort((names, -counts))[:VOCABULARY]
    order = np.sort(order[counts[order] >= COMMON])
    net = new_net(names[order])
    net["word"][1:, 0] = surprise[order]
    chunks = [(Text(w, net["known"]), y) for w, y in held]
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 if epoch < epochs // 2 else 0.3)
        for i in rng.permutation(len(chunks)):
            t, y = chunks[i]
            power = logits(net, t)
            rows = np.flatnonzero(np.diff(t.bounds))
            if not len(rows):
                continue
            picks = np.array([t.bounds[r] + power[t.bounds[r] : t.bounds[r + 1]].argmax() for r in rows])
            grad = gradient(net, t, picks, y[rows].astype(np.float32), np.where(y[rows] > 0, 0.5 / share, 0.5 / (1 - share)))
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
                net[k] = (net[k] - rate * move).astype(np.float32)
    return net


def scores(net: Net, w: Words) -> np.ndarray:
    t = Text(w, net["known"])
    power = logits(net, t)
    out = np.zeros(len(w.counts))
    rows = np.flatnonzero(np.diff(t.bounds))
    if len(rows):
        out[rows] = logistic(np.maximum.reduceat(power, t.bounds[rows]).astype(np.float64))
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING) -> Net | None:
    """A network from rows (doc_id, text) and (doc_id, toxic); the sample is bounded."""
    marked = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", "toxic").distinct()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    short = docs.filter(F.length("text").between(1, TRAINING_CHARS)).select("doc_id", "text")
    few = [marked.filter(F.col("toxic") == k).orderBy(*order).limit(most) for k in (0, 1)]
    rows = short.join(F.broadcast(few[0].union(few[1])), "doc_id").orderBy(*order, "toxic", "text").collect()
    marks = np.array([r["toxic"] for r in rows], np.float32)
    if not len(rows) or marks.min() == marks.max():
        return None
    mixed = np.random.default_rng(3).permutation(len(rows))
    return fit([rows[i]["text"].encode() for i in mixed], marks[mixed])


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, w in chunked(batch["text"], True, 1 << 18, APART):
                found = scores(held.value, w) if held.value is not None else np.zeros(len(w.counts))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, len(found)), pa.array(found)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")
