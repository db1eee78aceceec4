"""Language-model scores from a trie of word pairs, stored by Elias-Fano.

The model interpolates: p(w | v) = max(c(v w) - D, 0) / c(v) + D * T(v) / c(v) * p(w),
where T(v) is the number of different words after v and p(w) = (c(w) + 1) / (N + V + 1).
Counts come from every training row; nothing is pruned.

Pairs are dealt to shards by their context. A shard's trie has four levels: its
words as a monotone sequence of hashes, its contexts likewise, the pointers to
each context's successors, also monotone, and the successors, whose numbers
within a context are made monotone over all contexts by adding the context's
place times the number of words. Each is stored by Elias-Fano: high bits in unary,
low bits packed. The discounted probabilities are quantised to 16 bits beside
the successors. The levels go through one file, which is mapped and removed
after a shard has answered, but they are not searched there: all four are
decoded into plain 64-bit arrays, so a shard takes the memory of those. A pair
is found by binary search for its number, the context's place times the number
of words plus the word's, among all pairs of the shard.

Blocks of documents send their distinct pairs with training counts, which build
the trie and query it at once. Frequent contexts, at most ``HOT`` of them, are
split by the word that follows into ``SALT`` contexts of their own, whose counts
a block adds up again, so that no shard gets more than its share.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparksync.llm.blocks import deltas, expand, open_block, pack_rows, send, shard_bounds, shard_count, shrink, undo_deltas, with_answers
from sparksync.llm.labelled import fold
from sparksync.llm.text import WHITE, Hasher, Slice, Words, mix
from sparksync.session import checkpointed

DISCOUNT = 0.75
HOT = 1024
SALT = 64
LEVELS = 65_535
LOWEST = -12.0  # log10 of the smallest probability a code stands for
BEGIN, END = np.uint64(1), np.uint64(2)


class EliasFano:
    """A monotone sequence of unsigned integers as two byte strings."""

    @staticmethod
    def encode(x: np.ndarray) -> bytes:
        n = len(x)
        top = int(x[-1]) if n else 0
        # Whole bytes of low bits, so that the high part is at most twice as long as the sequence.
        width = 0
        while n and (top >> (8 * width)) > 2 * n and width < 8:
            width += 1
        low = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width])
        high = (x >> np.uint64(8 * width) if width < 8 else np.zeros(n, np.uint64)).astype(np.int64)
        bits = np.zeros(int(high[-1]) + n + 1 if n else 0, bool)
        bits[high + np.arange(n)] = True
        packed = np.packbits(bits)
        return np.array([n, width, len(bits)], "<i8").tobytes() + low.tobytes() + packed.tobytes()

    def __init__(self, memory: np.ndarray, at: int) -> None:
        self.n, self.width, self.bits = memory[at : at + 24].view("<i8").tolist()
        low_end = at + 24 + self.n * self.width
        self.low = memory[at + 24 : low_end].reshape(self.n, self.width)
        self.end = low_end + -(-self.bits // 8)
        self.high = memory[low_end : self.end]

    def values(self) -> np.ndarray:
        place = np.flatnonzero(np.unpackbits(self.high, count=self.bits))
        whole = np.zeros((self.n, 8), np.uint8)
        whole[:, : self.width] = self.low
        high = (place - np.arange(self.n)).astype(np.uint64)
        return whole.view("<u8").ravel() | (high << np.uint64(8 * self.width) if self.width < 8 else np.uint64(0))


class Trie:
    """The levels of one shard, written to a file and decoded from it; codes and totals stay mapped."""

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray, path: str) -> None:
        """``context`` and ``word`` are sorted distinct pairs with a positive count."""
        words = np.unique(word)
        contexts, first, size = np.unique(context, return_index=True, return_counts=True)
        total = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
        place = np.repeat(np.arange(len(contexts)), size)
        numbers = place * len(words) + np.searchsorted(words, word)
        codes = quantise(np.maximum(count - DISCOUNT, 0) / total[place] if len(place) else np.zeros(0))
        pointers = np.concatenate([first, [len(word)]])
        with open(path, "wb") as f:
            for level in (words, contexts, pointers.astype(np.uint64), numbers.astype(np.uint64)):
                f.write(EliasFano.encode(level))
            f.write(codes.astype("<u2").tobytes())
            f.write(total.astype("<i8").tobytes())
        memory = np.memmap(path, np.uint8, "r")
        at, levels = 0, []
        for _ in range(4):
            levels.append(EliasFano(memory, at))
            at = levels[-1].end
        self.words, self.contexts, self.pointers = (x.values() for x in levels[:3])
        self.numbers = levels[3].values()
        self.codes = memory[at : at + 2 * self.numbers.size].view("<u2")
        self.totals = memory[at + 2 * self.numbers.size :].view("<i8")

    def find_contexts(self, x: np.ndarray) -> np.ndarray:
        """The place of each context, -1 for unknown ones."""
        at = np.searchsorted(self.contexts, x)
        at[at == len(self.contexts)] = 0
        return np.where(self.contexts[at] == x, at, -1) if len(self.contexts) else np.full(len(x), -1)

    def find_pairs(self, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each pair of a context's place and a word, 0 for unknown ones."""
        out = np.zeros(len(place), np.uint16)
        if not len(self.words):
            return out
        number = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        known = np.flatnonzero((place >= 0) & (self.words[number] == word))
        wanted = (place[known] * len(self.words) + number[known]).astype(np.uint64)
        at = np.minimum(np.searchsorted(self.numbers, wanted), len(self.numbers) - 1)
        hit = self.numbers[at] == wanted
        out[known[hit]] = self.codes[at[hit]]
        return out


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes from 1 to LEVELS on a logarithmic scale."""
    scale = np.log10(np.maximum(p, 10**LOWEST)) / LOWEST
    return 1 + np.rint((1 - scale) * (LEVELS - 1)).astype(np.int64)


def restore(code: np.ndarray) -> np.ndarray:
    """The probabilities that codes stand for, 0 for code 0."""
    return np.where(code > 0, 10 ** (LOWEST * (1 - (code.astype(float) - 1) / (LEVELS - 1))), 0.0)


class Pairs:
    """The tokens of a block and its distinct (context, word) pairs with training counts."""

    def __init__(self, s: Slice, train: np.ndarray, hot: np.ndarray, hasher: Hasher) -> None:
        words = Words(s.data, s.offsets, WHITE)
        hashes = hasher.words(s.data, words) | np.uint64(4)  # apart from BEGIN and END
        # Every row reads: BEGIN, its words, END.
        spots = words.first[:-1] + np.arange(s.n)
        n = len(hashes) + s.n
        self.next = np.empty(n, np.uint64)
        own = np.arange(len(hashes)) + words.doc
        self.next[own] = hashes
        self.next[words.first[1:] + np.arange(s.n)] = END
        self.prev = np.empty(n, np.uint64)
        self.prev[own + 1 if len(own) else own] = hashes
        self.prev[spots] = BEGIN
        self.row = np.repeat(np.arange(s.n), words.count + 1)
        is_hot = np.isin(self.prev, hot)
        self.sub = np.where(is_hot, mix(self.prev + mix(self.next) % np.uint64(SALT)), mix(self.prev))
        order = np.lexsort((self.next, self.sub))
        sub, nxt = self.sub[order], self.next[order]
        new = np.ones(n, bool)
        new[1:] = (sub[1:] != sub[:-1]) | (nxt[1:] != nxt[:-1])
        self.of = np.empty(n, np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.pair_sub, self.pair_next = sub[new], nxt[new]
        self.count = np.bincount(self.of, train[self.row], minlength=int(new.sum())).astype(np.int64)
        # All contexts a block must know: every part of a hot one, also for a word that only ends a pair.
        self.known = np.unique(np.concatenate([self.prev, self.next]))
        cold = self.known[~np.isin(self.known, hot) & (self.known != END)]
        warm = np.intersect1d(self.known, hot)
        parts = hot_parts(warm)
        subs = np.concatenate([mix(cold), parts.ravel()])
        names = np.concatenate([cold, np.repeat(warm, SALT)])
        order = np.argsort(subs)
        self.subs, self.names = subs[order], names[order]

    def messages(self, shards: int) -> list[tuple[int, bytes]]:
        size = np.bincount(np.searchsorted(self.subs, self.pair_sub), minlength=len(self.subs))
        ends = np.concatenate([[0], np.cumsum(size)])
        bounds = shard_bounds(self.subs, shards)
        out = []
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if a < b:
                lo, hi = ends[a], ends[b]
                # 48 bits tell the successors of one context apart.
                words = self.pair_next[lo:hi] >> np.uint64(16)
                out.append((k, shrink(deltas(self.subs[a:b]), size[a:b].astype(np.int32), words, self.count[lo:hi].astype(np.int32))))
        return out


def hot_parts(hot: np.ndarray) -> np.ndarray:
    """The contexts that each hot word is split into."""
    return mix(hot[:, None] + np.arange(SALT, dtype=np.uint64))


def _answer(messages: DataFrame, hot: np.ndarray) -> DataFrame:
    """Answers (shard, block, body) and, on one row per shard, how many words besides the hot ones it has learned."""

    def run(found: pa.Table) -> pa.Table:
        parts = [expand(b.as_py()) for b in found.column("body")]
        subs = [undo_deltas(p[0]) for p in parts]
        pair_sub = np.concatenate([np.repeat(s, p[1]) for s, p in zip(subs, parts, strict=True)])
        word = np.concatenate([p[2] for p in parts])
        count = np.concatenate([p[3] for p in parts]).astype(np.int64)
        cuts = np.cumsum([len(p[2]) for p in parts])[:-1]
        seen = np.flatnonzero(count)
        order = seen[np.lexsort((word[seen], pair_sub[seen]))]
        s, w = pair_sub[order], word[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        sums = np.add.reduceat(count[order], first) if len(first) else np.zeros(0, np.int64)
        handle, path = tempfile.mkstemp(suffix=".trie")
        os.close(handle)
        try:
            trie = Trie(s[first], w[first], sums, path)
            types = np.diff(trie.pointers.astype(np.int64))
            bodies = []
            for name, mine, word_part in zip(subs, parts, np.split(word, cuts), strict=True):
                place = trie.find_contexts(name)
                there = place >= 0
                total = np.where(there, trie.totals[place], 0) if len(trie.contexts) else np.zeros(len(name), np.int64)
                kinds = np.where(there, types[place], 0) if len(trie.contexts) else np.zeros(len(name), np.int64)
                bodies.append(shrink(total, kinds.astype(np.int32), trie.find_pairs(np.repeat(place, mine[1]), word_part)))
            contexts = int((~np.isin(trie.contexts, hot_parts(hot))).sum())
        finally:
            os.remove(path)
        n = [contexts] + [0] * (found.num_rows - 1)
        return found.select(["shard", "block"]).append_column("body", pa.array(bodies, pa.binary())).append_column("contexts", pa.array(n, pa.int64()))

    return messages.groupBy("shard").applyInArrow(run, "shard int, block long, body binary, contexts long")


def _frequent(blocks: DataFrame, text_col: str, train_col: str) -> tuple[np.ndarray, int, int]:
    """(hot words with BEGIN, training rows, training words): words that are about 1/HOT of all training words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for payload in batch.column(1):
                s = open_block(payload.as_py(), text_col)
                train = np.asarray(s.column(train_col)).astype(bool)
                words = Words(s.data, s.offsets, WHITE)
                hashes = (hasher.words(s.data, words) | np.uint64(4))[train[words.doc]]
                name, n = np.unique(hashes, return_counts=True)
                often = n * HOT >= len(hashes)
                word = np.concatenate([np.array([BEGIN]), np.array([END]), name[often]]).astype(np.uint64)
                count = np.concatenate([[train.sum()], [len(hashes)], n[often]])
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count.astype(np.int64))], ["word", "n"])

    counts = blocks.select("block", "payload").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows, words = (counts.filter(F.col("word") == int(k)).select(F.sum("n")).first()[0] or 0 for k in (BEGIN, END))
    # At most HOT words can have 1/HOT of all words.
    hot = counts.filter((F.col("word") != int(END)) & ((F.col("n") * HOT >= words) | (F.col("word") == int(BEGIN)))).select("word").collect()
    return np.sort(np.array([r.word for r in hot] or [int(BEGIN)], np.int64).view(np.uint64)), rows, words


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32(id as text) mod ``folds`` is ``held`` teach nothing. A null
    text is empty and has one token, its end. A row without an id is scored,
    teaches nothing, and held_out is null there. Repeated rows count as often
    as they are there. Other columns are not read. Without training rows
    every word is unknown.
    """
    shards = shard_count(docs, 4)
    rows = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"), F.coalesce(fold(id_col, folds) != held, F.lit(False)).alias("_train")
    )
    blocks = pack_rows(rows, "_text", 2 << 20)
    hot, train_rows, train_words = _frequent(blocks, "_text", "_train")

    def ask():
        hasher = Hasher()
        return lambda s: Pairs(s, np.asarray(s.column("_train")).astype(float), hot, hasher).messages(shards)

    answers = checkpointed(_answer(send(blocks, "_text", ask), hot))
    n_train = train_words + train_rows
    # The words of the shards, the hot ones without BEGIN, and END.
    vocabulary = (answers.agg(F.sum("contexts")).first()[0] or 0) + len(hot) - 1 + (train_rows > 0)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, n_known long, base_score double, score double"

    def finish():
        hasher = Hasher()

        def make(key: int, s: Slice, replies: dict[int, bytes]) -> pa.Table:
            p = Pairs(s, np.asarray(s.column("_train")).astype(float), hot, hasher)
            parts = [expand(replies[k]) for k in sorted(replies)]
            total, types, code = (np.concatenate([x[i] for x in parts]) for i in range(3))
            if len(total) != len(p.subs) or len(code) != len(p.pair_sub):
                raise RuntimeError("a block was recomputed with other rows; run the job again")
            # Sums over the parts of each word.
            names, of = np.unique(p.names, return_inverse=True)
            count = np.bincount(of, total, len(names)).astype(np.int64)
            kinds = np.bincount(of, types, len(names))
            of_next = np.minimum(np.searchsorted(names, p.next), len(names) - 1)
            c_next = np.where(p.next == END, train_rows, count[of_next])
            unigram = (c_next + 1) / (n_train + vocabulary + 1)
            of_prev = np.searchsorted(names, p.prev)
            c_prev = count[of_prev]
            own_part = total[np.searchsorted(p.subs, p.sub)]
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = restore(code[p.of]) * own_part / c_prev
                chance = np.where(c_prev > 0, seen + DISCOUNT * kinds[of_prev] / c_prev * unigram, unigram)
            columns = [
                np.bincount(p.row, minlength=s.n),
                np.bincount(p.row, c_next > 0, s.n).astype(np.int64),
                np.bincount(p.row, np.log10(unigram), s.n),
                np.bincount(p.row, np.log10(chance), s.n),
            ]
            return pa.Table.from_arrays([s.column("_id"), *map(pa.array, columns)], [id_col, "n_tokens", "n_known", "base_score", "score"])

        return make

    scored = with_answers(blocks, answers.select("shard", "block", "body"), "_text", finish, schema)
    return scored.select(
        id_col,
        (fold(id_col, folds) == held).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
