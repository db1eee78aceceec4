"""Corpus-wide token counts by dynamic programming over a shared trie of pre-tokens.

Blocks count their distinct pre-tokens, shards add the counts up, and the
distinct pre-tokens are dealt into ranges in sorted order. A task walks its
range as the depth-first order of their trie: what two neighbours have in common
is the path that stays, and only the nodes below it are computed. Each node
holds the forward state of its prefix, so every shared prefix is computed once;
a node where a pre-token ends adds that pre-token's count to the pieces on the
way back to the root.

For a unigram model the forward state is the best score and the last piece. For
a BPE model it is the last piece of the prefix's own encoding: a piece may
follow if merging the two alone leaves them apart, which singles out one piece.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparksync.llm.blocks import expand, pack_rows, send, shard_bounds, shard_count, shrink
from sparksync.llm.pieces import BLOCK_BYTES, Pieces, Splitter, _distinct, merge_encode, pack_words, unpack_words
from sparksync.llm.text import Slice


def word_counts(docs: DataFrame, pieces: Pieces, text_col: str = "text") -> DataFrame:
    """(word, n): how often each distinct pre-token occurs in all texts."""
    shards, pairs = shard_count(docs), pieces.pairs()

    def ask():
        splitter = Splitter(pairs)

        def make(s: Slice) -> list[tuple[int, bytes]]:
            words, names, of, _ = _distinct(s, splitter)
            counts = np.bincount(of, minlength=len(words)).astype(np.int64)
            bounds = shard_bounds(names, shards)
            return [(k, shrink(counts[a:b]) + pack_words(words[a:b])) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]

        return make

    def add(found: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for body in found.column("body"):
            raw = body.as_py()
            counts = expand(raw[: _first_part(raw)])[0]
            for word, n in zip(unpack_words(raw[_first_part(raw) :]), counts.tolist(), strict=True):
                total[word] += n
        return pa.table({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    messages = send(pack_rows(docs.select(text_col), text_col, BLOCK_BYTES), text_col, ask)
    return messages.groupBy("shard").applyInArrow(add, "word string, n long")


def _first_part(body: bytes) -> int:
    """Length of the first array of a body."""
    return 17 + int.from_bytes(body[9:17], "little")


class Forward:
    """Forward states along the current path of the trie."""

    def __init__(self, pieces: Pieces) -> None:
        self.bpe = pieces.kind == "bpe"
        self.scores = dict(zip(pieces.text, pieces.scores, strict=True))
        self.longest = pieces.longest
        self.low = min(pieces.scores, default=0.0) - 10.0
        self.pairs: dict[tuple[str, str], bool] = {}
        self.word = ""
        self.states: list[tuple[float, str]] = [(0.0, "")]

    def _follows(self, last: str, piece: str) -> bool:
        key = (last, piece)
        if key not in self.pairs:
            self.pairs[key] = merge_encode(last + piece, self.scores) == ([last, piece] if last else [piece])
        return self.pairs[key]

    def _node(self, word: str, i: int) -> tuple[float, str]:
        best: tuple[float, str] | None = None
        for n in range(min(self.longest, i), 0, -1):
            piece = word[i - n : i]
            score = self.scores.get(piece)
            if score is None and n > 1:
                continue
            before, last = self.states[i - n]
            if self.bpe:
                if self._follows(last, piece):
                    return 0.0, piece
            else:
                total = before + (self.low if score is None else score)
                if best is None or total > best[0]:
                    best = (total, piece)
        return best

    def pieces(self, word: str) -> list[str]:
        """The pieces of the next word in sorted order, from the last to the first."""
        common = 0
        for a, b in zip(word, self.word, strict=False):
            if a != b:
                break
            common += 1
        del self.states[common + 1 :]
        for i in range(common + 1, len(word) + 1):
            self.states.append(self._node(word, i))
        self.word = word
        out, i = [], len(word)
        while i:
            out.append(self.states[i][1])
            i -= len(out[-1])
        return out


def token_counts(docs: DataFrame, pieces: Pieces, text_col: str = "text") -> DataFrame:
    """(piece_id, n) of every piece that occurs when all texts are encoded.

    Null and empty texts add nothing. Repeated rows count as often as they are
    there. Other columns are not read.
    """
    numbers, zero = dict(zip(pieces.text, pieces.ids, strict=True)), pieces.byte_zero

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward, counts = Forward(pieces), Counter()
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in forward.pieces(word):
                    if piece in numbers:
                        counts[numbers[piece]] += n
                    else:
                        for b in piece.encode():
                            counts[zero + b] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["piece_id", "n"])

    words = word_counts(docs, pieces, text_col).repartitionByRange("word").sortWithinPartitions("word")
    return words.mapInArrow(run, "piece_id int, n long").groupBy("piece_id").agg(F.sum("n").alias("n"))
