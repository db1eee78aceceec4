"""Benchmark decontamination with a generalised suffix automaton of the test items.

All items go into one automaton over their words. A text's words are streamed
through it: the state holds the longest suffix read so far that occurs in any
item. Where that match reaches ``width`` words, the last ``width`` words are a
window of an item; an item of fewer words is one window and is looked for along
the suffix links. Before streaming, numpy finds the stretches whose
neighbouring word pairs all occur next to each other in some item, which every
window is, so that Python only walks these.

The items are cut into groups of about ``GROUP_WORDS`` words, which bounds an
automaton and what is broadcast. There is one pass over the documents per
group, in one stage without a shuffle.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparksync.llm.text import NOT_ALNUM, Hasher, Words, slices
from sparksync.session import checkpointed

GROUP_WORDS = 200_000
OVERLAP = "n_words int, first array<int>, last array<int>, begin array<int>, end array<int>, items array<string>"


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, np.ndarray]], width: int) -> None:
        """``items``: (item id, word hashes)."""
        self.width = width
        self.vocabulary = np.unique(np.concatenate([h for _, h in items] or [np.zeros(0, np.uint64)]))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(name, np.searchsorted(self.vocabulary, h).tolist()) for name, h in items if len(h)]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        order = sorted(range(len(self.len)), key=self.len.__getitem__)
        # The suffix of exactly ``width`` words of each state's longer matches.
        self.window = [0] * len(order)
        for v in order[1:]:
            up = self.link[v]
            self.window[v] = self.window[up] if self.len[up] >= width else v
        self.items: dict[int, set[str]] = {}
        short: dict[int, dict[int, set[str]]] = {}
        pairs, starters = set(), set()
        for name, codes in coded:
            v = 0
            for n, c in enumerate(codes, 1):
                v = self.next[v][c]
                if n >= width:
                    self.items.setdefault(self.window[v], set()).add(name)
            if len(codes) < width:
                while self.len[self.link[v]] >= len(codes):
                    v = self.link[v]
                short.setdefault(v, {}).setdefault(len(codes), set()).add(name)
                starters.add(codes[0])
            pairs.update(a * len(self.vocabulary) + b for a, b in itertools.pairwise(codes))
        self.short: list[tuple] = [()] * len(order)
        for v in order:
            above = self.short[self.link[v]] if v else ()
            self.short[v] = above + tuple(sorted((n, frozenset(s)) for n, s in short.get(v, {}).items()))
        self.pairs = np.array(sorted(pairs), np.int64)
        self.starters = np.array(sorted(starters), np.int64)
        self.prefixes = np.zeros(1 << 16, bool)
        self.prefixes[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(step)
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the strings of ``q`` that are no longer than one word after ``p``."""
        copy = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, c)
        new = self._state(self.len[last] + 1, 0, {})
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return new

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, -1 for others."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.vocabulary):
            near = np.flatnonzero(self.prefixes[(hashes >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[near]), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == hashes[near]
            out[near[known]] = at[known]
        return out

    def stretches(self, codes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of words that may hold a window."""
        if not len(codes):
            return
        pair = codes[:-1] * len(self.vocabulary) + codes[1:]
        tied = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0) & (doc[:-1] == doc[1:]))
        glued = np.zeros(len(codes) + 1, bool)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair[tied]), len(self.pairs) - 1)
            glued[tied[self.pairs[at] == pair[tied]] + 1] = True
        starts = np.flatnonzero((codes >= 0) & ~glued[:-1])
        ends = np.flatnonzero((codes >= 0) & ~glued[1:]) + 1
        starter = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(np.isin(codes, self.starters), out=starter[1:])
        keep = (ends - starts >= self.width) | (starter[ends] > starter[starts])
        yield from zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)

    def stream(self, codes: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(end, length, items) of every window that ends at a word of ``codes``."""
        v = matched = 0
        for i, c in enumerate(codes):
            while v and c not in self.next[v]:
                v = self.link[v]
                matched = self.len[v]
            if c in self.next[v]:
                v = self.next[v][c]
                matched += 1
            if matched >= self.width and (items := self.items.get(self.window[v])):
                yield i, self.width, items
            for n, items in self.short[v]:
                if n <= matched:
                    yield i, n, items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _groups(items: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The items in groups of about GROUP_WORDS words; a longer item has one to itself or with few others."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    letters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-letters // (4 * GROUP_WORDS)) or 1
    rows = rows.withColumn("g", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    return [rows.filter(F.col("g") == g).select("item", "text") for g in range(n)]


def _automaton(group: DataFrame, width: int) -> Automaton:
    """Of one group, whose size ``_groups`` bounds."""
    hasher, found = Hasher(), []
    rows = [r for r in group.collect() if r.item is not None]
    if rows:
        batch = pa.RecordBatch.from_arrays([pa.array([r.item for r in rows]), pa.array([r.text for r in rows])], ["item", "text"])
        for s in slices(iter([batch]), "text"):
            words = Words(s.data, s.offsets, NOT_ALNUM)
            hashes = hasher.words(s.data, words)
            names = s.column("item").to_pylist()
            found += [(names[i], hashes[words.first[i] : words.first[i + 1]]) for i in range(s.n)]
    return Automaton(found, width)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front while the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mark_overlaps(
    docs: DataFrame, items: DataFrame, width: int = 13, text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of what they share with ``items``, and its name.

    The struct has n_words, the hit stretches as ``first`` and ``last`` word
    (from 0) and as ``begin`` and ``end`` byte, and the ids of the items with
    occurring windows, sorted as strings. Null and empty texts have no words.
    Items without words, text or id match nothing; repeated items count once.
    The other columns of ``docs`` pass through whatever their names are.
    """
    out = free_name(docs, "overlap")
    kind = T._parse_datatype_string(OVERLAP)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, kind)])
    arrow = pa.struct([("n_words", pa.int32()), *((k, pa.list_(pa.int32())) for k in ("first", "last", "begin", "end")), ("items", pa.list_(pa.string()))])
    sc = docs.sparkSession.sparkContext
    marked, names_in = docs, docs.columns
    for at, group in enumerate(_groups(items, item_id, item_text)):
        shared = sc.broadcast(cloudpickle.dumps(_automaton(group, width)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            hasher, automaton = Hasher(), pickle.loads(shared.value)
            for s in slices(batches, text_col):
                words = Words(s.data, s.offsets, NOT_ALNUM)
                codes = automaton.codes(hasher.words(s.data, words))
                spans: dict[int, list[tuple[int, int]]] = {}
                names: dict[int, set[str]] = {}
                for a, b in automaton.stretches(codes, words.doc):
                    d = int(words.doc[a])
                    for i, n, found in automaton.stream(codes[a:b].tolist()):
                        spans.setdefault(d, []).append((a + i + 1 - n, a + i))
                        names.setdefault(d, set()).update(found)
                before = s.column(out).to_pylist() if at else [None] * s.n
                rows = []
                for d in range(s.n):
                    lo, old = int(words.first[d]), before[d]
                    hits = [(a - lo, b - lo) for a, b in spans.get(d, ())]
                    ids = names.get(d, set())
                    if old:
                        hits += zip(old["first"], old["last"], strict=True)
                        ids = ids | set(old["items"])
                    hits = _merge(hits)
                    zero = int(s.offsets[d])
                    rows.append(
                        {
                            "n_words": int(words.count[d]),
                            "first": [a for a, _ in hits],
                            "last": [b for _, b in hits],
                            "begin": [int(words.start[lo + a]) - zero for a, _ in hits],
                            "end": [int(words.end[lo + b]) - zero for _, b in hits],
                            "items": sorted(ids),
                        }
                    )
                columns = [s.batch.column(i) for i in range(len(names_in))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, arrow)], names=[*names_in, out])

        marked = marked.mapInArrow(run, schema)
        if at % 4 == 3:
            marked = checkpointed(marked)
    return marked, out


def n_hit(overlap: str) -> Column:
    """Words inside any occurrence of a window."""
    return F.aggregate(
        F.zip_with(F.col(f"{overlap}.first"), F.col(f"{overlap}.last"), lambda a, b: b - a + 1), F.lit(0), lambda x, y: x + y
    ).cast("long")


def is_contaminated(overlap: str) -> Column:
    """At least a twentieth of the words is hit."""
    return (n_hit(overlap) > 0) & (n_hit(overlap) * 20 >= F.col(f"{overlap}.n_words"))


def kept_pieces(raw: bytes, begin: list[int], end: list[int]) -> bytes:
    """``raw`` without the given runs."""
    edges = [0, *itertools.chain.from_iterable(zip(begin, end, strict=True)), len(raw)]
    return b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))


def cut_bytes(docs: DataFrame, text_col: str, begin: str, end: str) -> DataFrame:
    """``docs`` without the byte spans that the array columns ``begin`` and ``end`` name in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            spans = zip(batch.column(batch.schema.get_field_index(begin)).to_pylist(), batch.column(batch.schema.get_field_index(end)).to_pylist(), strict=True)
            for i, (b, e) in enumerate(spans):
                if b and texts[i] is not None:
                    texts[i] = kept_pieces(texts[i].encode(), b, e).decode(errors="ignore")
            keep = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] not in (begin, end)]
            yield pa.RecordBatch.from_arrays(keep, [c for c in batch.schema.names if c not in (begin, end)])

    fields = [f for f in docs.schema.fields if f.name not in (begin, end)]
    return docs.mapInArrow(run, T.StructType(fields))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, drop_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the test passages of contaminated documents.

    A document with fewer than a twentieth of its words hit stays as it is. Of
    others the hit stretches are cut out; if they are ``drop_share`` of the
    words or more, the document goes.
    """
    marked, out = mark_overlaps(docs, items, width, text_col)
    begin, end = free_name(docs, "begin"), free_name(docs, "end")
    dirty = is_contaminated(out)
    kept = marked.filter(~dirty | (n_hit(out) < F.col(f"{out}.n_words") * F.lit(drop_share)))
    spans = kept.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.when(dirty, F.col(f"{out}.begin")).alias(begin),
        F.when(dirty, F.col(f"{out}.end")).alias(end),
    )
    return cut_bytes(spans, text_col, begin, end)
