"""Words and their hashes for whole Arrow batches of texts.

A batch's texts are one byte buffer with offsets. Words are found and hashed
for the whole buffer at once with numpy, never word by word. Word hashes are
64-bit polynomials over a random value per byte, with the length mixed in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
BASE = 0x9E3779B97F4A7C15
WHITE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))


class Slice:
    """Some rows of a batch: their texts as bytes, with offsets."""

    def __init__(self, batch: pa.RecordBatch, text: str, start: int, stop: int, offsets, data) -> None:
        self.batch = batch.slice(start, stop - start)
        lo, hi = int(offsets[start]), int(offsets[stop])
        self.data = data[lo:hi]
        self.offsets = offsets[start : stop + 1].astype(np.int64) - lo
        self.n = stop - start

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; a null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut batches into slices of at most ``limit`` bytes of text; a longer text has one to itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, data = buffers(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), start + 60_000, batch.num_rows)
            yield Slice(batch, text, start, stop, offsets, data)
            start = stop


def fold_case() -> np.ndarray:
    """A byte table that turns A-Z to a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


class Words:
    """The words of a slice: ``start`` and ``end`` byte, ``doc`` row, ``first`` word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: bytes) -> None:
        inside = np.ones(256, bool)
        inside[list(separators)] = False
        word = inside[data]
        before = np.empty(len(data) + 1, bool)
        before[0] = False
        before[1:] = word
        opens = word & ~before[:-1]
        bounds = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[bounds] = word[bounds]
        self.start = np.flatnonzero(opens)
        after = np.zeros(len(data) + 1, bool)
        after[: len(data)] = word
        closes = word & ~after[1:]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        closes[last] = word[last]
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.inside = inside


class Hasher:
    """Hashes of words; made once per task, as its power tables are large."""

    def __init__(self, seed: int = 1, lower: bool = True) -> None:
        values = seeds(256, seed)
        self.values = values[fold_case()] if lower else values
        self.power = self.inverse = np.ones(0, np.uint64)

    def _reserve(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n + n // 8, 1 << 20)
            base = np.full(n, BASE, np.uint64)
            base[0] = 1
            self.power = np.cumprod(base, dtype=np.uint64)
            base[1:] = pow(BASE, -1, 1 << 64)
            self.inverse = np.cumprod(base, dtype=np.uint64)

    def words(self, data: np.ndarray, words: Words) -> np.ndarray:
        if not len(words.start):
            return np.zeros(0, np.uint64)
        self._reserve(len(data))
        terms = (self.values * words.inside)[data]
        terms *= self.power[: len(data)]
        sums = np.add.reduceat(terms, words.start)
        sums *= self.inverse[words.start]
        sums += (words.end - words.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(sums)

    def windows(self, data: np.ndarray, width: int) -> np.ndarray:
        """A hash for each run of ``width`` bytes of ``data``."""
        if len(data) < width:
            return np.zeros(0, np.uint64)
        self._reserve(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=sums[1:])
        runs = (sums[width:] - sums[:-width]) * self.inverse[: len(data) - width + 1]
        return mix(runs)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
