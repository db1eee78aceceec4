"""Repeated passages: every byte under a string of ``width`` bytes that also starts earlier.

The suffixes of all texts are ordered blockwise, as far as ``width`` bytes
count. A cover sample comes first: in every ``width`` bytes some positions are
sampled: for each suffix the smallest hash of ``GRAM`` bytes in its width, which
is the same one wherever the same bytes stand. Suffixes can only tie to the full
width if their samples tie, and what is known of the samples, whether another
place has the same one, leaves only a small part of all suffixes. These are
dealt into buckets by the name of their first ``width`` bytes. One bucket at a
time is sorted by name, and the first document of each name is its earliest
start; a task's memory is bounded by its bucket. Names are 64-bit hashes, so
that a bucket is even whatever the texts begin with, and no common prefix makes
a long comparison.

A row whose whole text another row with a smaller id has is settled by that
alone and sends no suffixes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sparksync.llm.blocks import (
    MESSAGE, answer, deltas, expand, message_batch, pack_rows, send, shard_bounds, shard_count, shrink, undo_deltas, with_answers,
)
from sparksync.llm.decontaminate import cut_bytes, free_name
from sparksync.llm.text import Hasher, Slice, mix

GRAM = 32


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``width`` neighbouring values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def room(offsets: np.ndarray, usable: np.ndarray, width: int) -> np.ndarray:
    """Whether ``width`` bytes of the same usable row begin at each byte."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int8)
    rows = np.flatnonzero(usable & (np.diff(offsets) >= width))
    edge[offsets[:-1][rows]] += 1
    edge[offsets[1:][rows] - width + 1] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


class Suffixes:
    """The texts of a block: names of byte runs, cover sample, candidates."""

    def __init__(self, s: Slice, id_col: str, hasher: Hasher, width: int) -> None:
        column = s.column(id_col)
        self.ids = np.asarray(column.fill_null(0)).astype(np.int64)
        self.usable = np.asarray(column.is_valid()).astype(bool)
        self.s, self.width = s, width
        self.gram = min(GRAM, max(1, width // 3))
        n = len(s.data)
        hasher._reserve(n + 1)
        self.inverse = hasher.inverse
        self.sums = np.zeros(n + 1, np.uint64)
        terms = hasher.values[s.data]
        terms *= hasher.power[:n]
        np.cumsum(terms, out=self.sums[1:])

    def names(self, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        return mix((self.sums[starts + width] - self.sums[starts]) * self.inverse[starts])

    def rows_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.s.offsets, starts, "right") - 1

    def take_sample(self) -> Entries:
        """Sampled grams, and the whole text of each row as one more entry."""
        offsets, span, n = self.s.offsets, self.width - self.gram + 1, len(self.s.data)
        self.sample = np.zeros(0, np.int64)
        self.grams = np.zeros(0, np.uint64)
        self.valid = room(offsets, self.usable, self.width)
        if n >= self.width:
            sums = self.sums[self.gram :] - self.sums[: -self.gram]
            sums *= self.inverse[: n - self.gram + 1]
            grams = mix(sums)
            inside = room(offsets, self.usable, self.gram)[: len(grams)]
            # 31 bits of each gram's hash; the lowest bit is free for a flag.
            self.order = (grams >> np.uint64(33)).astype(np.uint32) << np.uint32(1)
            self.order[~inside] = 2**32 - 2
            low = sliding(self.order, span, np.minimum)
            padded = np.zeros(len(low) + 2 * (span - 1), np.uint32)
            padded[span - 1 : span - 1 + len(low)] = low * self.valid[: len(low)]
            self.sample = np.flatnonzero((sliding(padded, span, np.maximum) == self.order) & inside)
            self.grams = grams[self.sample]
        lengths = np.diff(offsets)
        self.long_rows = np.flatnonzero(self.usable & (lengths >= self.width))
        lengths = lengths[self.long_rows]
        texts = mix(self.names(offsets[:-1][self.long_rows], lengths) + lengths.astype(np.uint64))
        return Entries(np.concatenate([self.grams, texts]), np.concatenate([self.rows_of(self.sample), self.long_rows]), self.ids)

    def candidates(self, copy: np.ndarray, tied: np.ndarray) -> np.ndarray:
        """Starts whose own sample, the smallest in their width, is tied, outside copies of whole texts."""
        if not len(self.sample):
            return np.zeros(0, np.int64)
        flagged = self.order | np.uint32(1)
        flagged[self.sample[tied]] ^= np.uint32(1)
        own = sliding(flagged, self.width - self.gram + 1, np.minimum) & np.uint32(1)
        starts = np.flatnonzero(self.valid[: len(own)] & (own == 0))
        return starts[~copy[self.rows_of(starts)]]

    def entries(self, starts: np.ndarray) -> Entries:
        self.starts, self.rows = starts, self.rows_of(starts)
        return Entries(self.names(starts, self.width), self.rows, self.ids)


class Entries:
    """Distinct names of a block, each with the smallest id that has it, and what was said of it."""

    def __init__(self, names: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids[rows], names))
        sorted_names = names[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_names[1:] != sorted_names[:-1]
        self.names = sorted_names[new]
        self.ids = ids[rows[order]][new]
        self.of = np.empty(len(order), np.int64)  # entry of each given name
        self.of[order] = np.cumsum(new) - 1
        self.times = np.bincount(self.of, minlength=len(self.names))

    def messages(self, shards: int) -> list[tuple[int, bytes]]:
        bounds = shard_bounds(self.names, shards)
        return [
            (k, shrink(deltas(self.names[a:b]), self.ids[a:b]))
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
            if a < b
        ]

    def replies(self, replies: dict[int, bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether a smaller id has each entry, and whether another block has it."""
        bounds = shard_bounds(self.names, shards)
        code = np.zeros(len(self.names), np.uint8)
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if a < b:
                said = expand(replies[k])[0]
                if len(said) != b - a:
                    raise RuntimeError("a block was recomputed with other rows; run the job again")
                code[a:b] = said
        return (code & 1) > 0, (code & 2) > 0


def first_of_each(bodies: list[bytes]) -> list[bytes]:
    """Sort one bucket by name: which entries start earlier elsewhere, and which are shared at all."""
    parts = [expand(b) for b in bodies]
    names = np.concatenate([undo_deltas(n) for n, _ in parts])
    ids = np.concatenate([i for _, i in parts])
    order = np.argsort(names, kind="stable")
    name, held = names[order], ids[order]
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(held, np.flatnonzero(new))[group]
    code = np.empty(len(name), np.uint8)
    code[order] = (least < held) | ((np.bincount(group)[group] > 1).astype(np.uint8) << 1)
    return [shrink(c) for c in np.split(code, np.cumsum([len(i) for _, i in parts])[:-1])]


def mark_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` with the removed byte runs of each text as two array columns, and their names.

    A start counts as earlier in a row with a smaller id, or before in the same
    row; rows that share an id do not match each other. A null text is empty. A
    row without an id matches nothing and loses nothing. Overlapping matches
    count, and matches are judged on the texts as they were given. The other
    columns pass through whatever their names are.
    """
    # A bucket holds the candidates of a quarter of a scan partition.
    shards = shard_count(docs, 4)
    begin_col, end_col = free_name(docs, "begin"), free_name(docs, "end")
    spans = T.ArrayType(T.IntegerType())
    schema = T.StructType([*docs.schema.fields, T.StructField(begin_col, spans), T.StructField(end_col, spans)])
    blocks = pack_rows(docs, text_col, 2 << 20)

    def ask_samples():
        hasher = Hasher(seed=5, lower=False)

        def make(s: Slice) -> list[tuple[int, bytes]]:
            return Suffixes(s, id_col, hasher, width).take_sample().messages(shards)

        return make

    def ask_windows():
        hasher = Hasher(seed=5, lower=False)

        def make(key: int, s: Slice, replies: dict[int, bytes]) -> pa.Table:
            found = Suffixes(s, id_col, hasher, width)
            samples = found.take_sample()
            earlier, shared = samples.replies(replies, shards)
            tied = shared | (samples.times > 1)
            copy = np.zeros(s.n, bool)
            own = samples.of[len(found.sample) :]
            copy[found.long_rows] = earlier[own] | (samples.ids[own] < found.ids[found.long_rows])
            starts = found.candidates(copy, tied[samples.of[: len(found.sample)]])
            # What was found out goes along to the last step, past the shards.
            marks = np.zeros(len(s.data), bool)
            marks[starts] = True
            memo = shrink(np.packbits(marks), copy.view(np.uint8))
            parts = found.entries(starts).messages(shards)
            return pa.Table.from_batches([message_batch(key, [*parts, (-1 - key % shards, memo)])])

        return make

    def finish():
        hasher = Hasher(seed=5, lower=False)

        def make(key: int, s: Slice, replies: dict[int, bytes]) -> pa.Table:
            found = Suffixes(s, id_col, hasher, width)
            marks, copy = expand(replies.pop(-1 - key % shards))
            copy = copy.view(bool)
            starts = np.flatnonzero(np.unpackbits(marks, count=len(s.data)))
            entries = found.entries(starts)
            earlier, _ = entries.replies(replies, shards)
            rows = found.rows
            gone = earlier[entries.of] | (entries.ids[entries.of] < found.ids[rows])
            # Starts after another start of the same name in the same row.
            order = np.lexsort((rows, entries.of))
            same = (np.diff(entries.of[order]) == 0) & (np.diff(rows[order]) == 0)
            gone[order[1:][same]] = True
            edge = np.zeros(len(s.data) + 1, np.int32)
            edge[starts[gone]] += 1
            edge[starts[gone] + width] -= 1
            removed = np.cumsum(edge[:-1]) > 0
            for r in np.flatnonzero(copy):
                removed[s.offsets[r] : s.offsets[r + 1]] = True
            begins, ends = runs_of(removed, s.offsets)
            columns = [*s.batch.columns, *(list_column(x, s.offsets) for x in (begins, ends))]
            return pa.Table.from_arrays(columns, [*s.batch.schema.names, begin_col, end_col])

        def runs_of(removed: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Begin and end of the maximal runs, none across a row's edge."""
            edge = np.zeros(len(removed) + 1, bool)
            edge[offsets] = True
            before = np.concatenate([[False], removed[:-1]])
            after = np.concatenate([removed[1:], [False]])
            return np.flatnonzero(removed & (~before | edge[:-1])), np.flatnonzero(removed & (~after | edge[1:]))

        def list_column(at: np.ndarray, offsets: np.ndarray) -> pa.Array:
            row = np.searchsorted(offsets, at, "right") - 1
            cuts = np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(cuts), pa.array((at - offsets[row]).astype(np.int32)))

        return make

    about_samples = answer(send(blocks, text_col, ask_samples), first_of_each)
    asked = with_answers(blocks, about_samples, text_col, ask_windows, MESSAGE)
    about_windows = answer(asked, first_of_each)
    marked = with_answers(blocks, about_windows, text_col, finish, schema)
    return marked.withColumn(end_col, F.transform(end_col, lambda x: x + 1)), (begin_col, end_col)


def remove_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated bytes; a cut through a character drops its rest."""
    marked, (begin, end) = mark_repeats(docs, width, id_col, text_col)
    return cut_bytes(marked, text_col, begin, end)
