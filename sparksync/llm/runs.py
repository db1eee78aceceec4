"""Periodic stretches (runs) of the words of each text, and texts with repeated periods collapsed.

A suffix automaton of a stretch of words is built; its suffix links are a tree
whose nodes are coloured by the position where their words last ended. Reading
word ``i`` recolours the path from its prefix state to the root: a link-cut
access meets one path segment per earlier colour. If a segment with colour
``c`` reaches ``n`` words deep and ``i - c <= n``, then a square of period
``i - c`` ends at ``i``, and the deepest node tells how far it extends to the
left. The last such ``i`` of a (start, period) is where the run ends.

Only stretches that can hold a run are read this way. In a run of at least
``periods`` periods every short word sequence occurs again and again, so
stretches are cut, until nothing changes, where a sequence occurs less often
than that. This is decided for a whole batch with numpy and never loses a run.
Words are compared there by 64-bit hashes, where a collision only keeps more,
and in the automaton by their bytes.

Every text is looked at on its own, so nothing is shuffled. A task holds some
20 bytes per word of a batch and about half a kilobyte per word of the longest
stretch; long texts are hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from sparksync.llm.decontaminate import free_name
from sparksync.llm.text import SLICE_BYTES, WHITE, Hasher, Words, mix, slices

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RUNS = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
)


class LinkCut:
    """Coloured paths of a forest; each splay tree is one preferred path and has one colour, kept at its root."""

    def __init__(self, parent: list[int]) -> None:
        n = len(parent)
        self.up, self.left, self.right, self.colour = parent, [0] * n, [0] * n, [-1] * n

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            child = left[p] = right[x]
            right[x] = p
        else:
            child = right[p] = left[x]
            left[x] = p
        if child:
            up[child] = p
        up[p] = x
        up[x] = g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        else:  # p was the root
            self.colour[x] = self.colour[p]

    def splay(self, x: int) -> None:
        # Node 0 has no children, so that a root's parent 0 never counts as a parent in the same tree.
        up, left, right = self.up, self.left, self.right
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def recolour(self, v: int, colour: int) -> list[tuple[int, int]]:
        """Give the path from ``v`` to its root ``colour``; returns (old colour, deepest node) of the segments it crosses."""
        up, right, colours = self.up, self.right, self.colour
        crossed, x, below = [], v, 0
        while x:
            self.splay(x)
            old = colours[x]
            if old >= 0:
                crossed.append((old, x))
            rest = right[x]
            if rest:
                colours[rest] = old
            right[x] = below
            below, x = x, up[x]
        self.splay(v)
        colours[v] = colour
        return crossed


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, suffix link, state of each prefix) of the suffix automaton; the initial state is 1, its link 0."""
    length, link, following, prefix = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for c in words:
        state = len(length)
        length.append(length[last] + 1)
        link.append(1)
        following.append({})
        p = last
        while p and c not in following[p]:
            following[p][c] = state
            p = link[p]
        if p:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                following.append(following[q].copy())
                link[q] = link[state] = clone
                while p and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
        last = state
        prefix.append(state)
    return length, link, prefix


def runs_of(words: list[int], least: int, periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with at least ``least`` words and ``periods`` (two or more) periods."""
    length, link, prefix = automaton(words)
    paths = LinkCut([0 if p == 1 else p for p in link])
    ends: dict[tuple[int, int], int] = {}
    for i, state in enumerate(prefix):
        for before, deepest in paths.recolour(state, i):
            period, n = i - before, length[deepest]
            if period <= n:
                ends[i - n - period + 1, period] = i
    return sorted((s, e - s + 1, q) for (s, q), e in ends.items() if e - s + 1 >= max(least, periods * q))


def stretches(codes: np.ndarray, doc: np.ndarray, least: int, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the stretches that can hold a run; they stay inside a document."""
    # A sequence of k words occurs periods - 1 times in a run, if the run is not too short for it.
    need, k = (periods - 1, min(3, max(least, periods) - periods + 2)) if periods > 2 else (2, 1)
    starts = np.arange(max(len(codes) - k + 1, 0))
    starts = starts[doc[starts] == doc[starts + k - 1]]
    grams = np.zeros(len(starts), np.uint64)
    for j in range(k):
        grams = mix(grams + codes[starts + j])
    part = doc[starts].astype(np.uint64)
    while True:
        before = len(starts)
        _, which, times = np.unique(mix(grams ^ mix(part + np.uint64(1))), return_inverse=True, return_counts=True)
        keep = times[which] >= need
        starts, grams, part = starts[keep], grams[keep], part[keep]
        cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(part) != 0)) + 1
        bounds = np.concatenate([[0], cut, [len(starts)]]) if len(starts) else np.zeros(1, np.int64)
        sizes = np.diff(bounds)
        keep = np.repeat(sizes + k - 1 >= max(least, periods), sizes)
        part = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)[keep]
        starts, grams = starts[keep], grams[keep]
        if len(starts) == before:
            break
    first = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return starts[first], starts[last] + k


def coded_words(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of all words; a text above a slice is hashed piece by piece, cut between words."""
    white = np.zeros(256, bool)
    white[list(WHITE)] = True
    found, at = [], 0
    while at < len(data):
        stop, step = len(data), SLICE_BYTES
        while stop - at > step:
            gaps = np.flatnonzero(white[data[at : at + step]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
                break
            step *= 2
        inner = np.clip(offsets, at, stop) - at
        words = Words(data[at:stop], inner, WHITE)
        found.append((words.start + at, words.end + at, words.doc, hasher.words(data[at:stop], words)))
        at = stop
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _collapse(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each row with one space between them."""
    start, end, doc = start[kept], end[kept], doc[kept]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    gaps = end[:-1][doc[:-1] == doc[1:]]
    mask[gaps] = True
    data = data.copy()
    data[gaps] = 0x20
    sizes = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=sizes[1:])
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(sizes[offsets].astype(np.int64)), pa.py_buffer(data[mask].tobytes())])


def find_runs(docs: DataFrame, text: str = "text", least: int = 6, periods: int = 4) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of (n_words, runs, collapsed), and the name of that column.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0. A
    run is a stretch with a smallest period q, at least ``least`` words and
    ``periods`` * q long (``periods`` is two or more), that no neighbouring
    word extends. ``runs`` is sorted by start, then period; ``collapsed`` has
    the words that no run contains after its first period, joined by a space.

    A null or empty text has no words, no runs and an empty ``collapsed``.
    Repeated rows each get their own result, an empty table stays empty, other
    columns pass through whatever their names are.
    """
    if periods < 2 or least < 1:
        raise ValueError("a run has two periods and one word at least")
    out = free_name(docs, "word_runs")
    names_in = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(out, RUNS)])

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed=12, lower=False)
        for piece in slices(batches, text, SLICE_BYTES // 4):
            start, end, doc, codes = coded_words(piece.data, piece.offsets, hasher)
            first = np.searchsorted(doc, np.arange(piece.n + 1))
            kept = np.ones(len(start), bool)
            found: list[list[dict]] = [[] for _ in range(piece.n)]
            for a, b in zip(*stretches(codes, doc, least, periods), strict=True):
                number: dict[bytes, int] = {}
                words = [number.setdefault(piece.data[start[i] : end[i]].tobytes(), len(number)) for i in range(a, b)]
                row = int(doc[a])
                for s, n, q in runs_of(words, least, periods):
                    kept[a + s + q : a + s + n] = False
                    found[row].append({"start": a + s - int(first[row]), "length": n, "period": q})
            for x in found:
                x.sort(key=lambda r: (r["start"], r["period"]))
            result = pa.StructArray.from_arrays(
                [
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                    _collapse(piece.data, piece.offsets, start, end, doc, kept).cast(pa.string()),
                ],
                names=["n_words", "runs", "collapsed"],
            )
            yield pa.RecordBatch.from_arrays([*piece.batch.columns, result], names=[*names_in, out])

    return docs.mapInArrow(per_task, schema), out
