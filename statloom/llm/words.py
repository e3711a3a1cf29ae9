"""Words of whole texts and their hashes, as numpy arrays.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return. Texts are taken from Arrow columns in chunks of about
a megabyte, so memory does not depend on the batch, only on the longest text.
Hashes have 64 bits and are the same on every machine; unequal inputs share one
with a chance of about 2**-64 for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit over the result."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashed sequences, one after the other."""
    return mix((left << np.uint64(1) | left >> np.uint64(63)) ^ mix(right))


class Words:
    """Word positions and hashes of some texts held in one byte buffer."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, fold: bool = False, space: np.ndarray = SPACE):
        self.data, self.bounds = (FOLD[data] if fold else data), bounds
        inside = ~space[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        self.stops = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, bounds)
        """Number of the first word of each text, and of the one after the last."""

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        window = np.lib.stride_tricks.sliding_window_view(padded, 8)
        left = self.stops - self.starts
        out = mix(left.astype(np.uint64))
        live, at = np.arange(len(left)), self.starts
        while len(live):
            block = np.ascontiguousarray(window[at]).view("<u8").ravel() & _KEEP[np.minimum(left, 8)]
            out[live] = mix(out[live] ^ block)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return out

    def text(self, row: int) -> bytes:
        return self.data[self.bounds[row] : self.bounds[row + 1]].tobytes()


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 words start none."""
    if len(hashes) < n:
        return hashes[:0]
    done, size, total = None, 0, len(hashes) - n + 1
    power, width = hashes, 1
    while size < n:
        if n & width:
            part = power[size : size + total]
            done = part if done is None else join(done, part)
            size += width
        if size < n:
            power, width = join(power[: len(power) - width], power[width:]), 2 * width
    return done


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence; unlike the hash of any n words of ``grams``."""
    out = np.array([len(hashes)], np.uint64)
    for h in hashes:
        out = join(mix(out), np.array([h], np.uint64))
    return out[0]


def chunked(texts: pa.Array, fold: bool = False, most: int = CHUNK_BYTES, space: np.ndarray = SPACE) -> Iterator[tuple[int, Words]]:
    """The first row and the words of each run of texts of at most ``most`` bytes (one text at least); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    wide = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    buffer = wide.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(wide):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        lo, hi = offsets[row], offsets[stop]
        yield row, Words(data[lo:hi], offsets[row : stop + 1] - lo, fold, space)
        row = stop
