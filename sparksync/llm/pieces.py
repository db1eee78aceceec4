"""SentencePiece encoding and decoding as a relational lattice over distinct words.

A text is cut where no piece of the model has the two neighbouring characters
next to each other; no piece can cross such a place, so the parts, called words
here, are encoded independently and exactly. Distinct words of all blocks go
through the lattice once: substrings of bounded length are exploded, joined to
the piece table, grouped by word as edges and folded with Spark's higher-order
``aggregate``. For unigram models the fold is Viterbi: the best score of each
end is taken over the edges that end there. The scores of a BPE model are merge
ranks, whose sums mean nothing; there the fold merges, at each step, the
neighbouring segments whose joint edge has the best score, the leftmost of
equals. Words longer than ``LONG`` characters, for which a fold would be
quadratic, are encoded by the same rules in Python.

Characters without a piece become their UTF-8 bytes' pieces. Decoding joins the
pieces' bytes and turns marks back into spaces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparksync.functions.binding import let
from sparksync.llm.blocks import MESSAGE, expand, pack_rows, send_rows, shard_bounds, shard_count, shrink, with_answers
from sparksync.llm.decontaminate import free_name
from sparksync.llm.text import BASE, Slice, mix, seeds
from sparksync.session import checkpointed, drop_superseded

MARK = "▁"
UNKNOWN = "\ufffd".encode()
LONG = 48
BLOCK_BYTES = 3 << 19  # as characters of four bytes and hashes of eight, a block takes many times that
MOST_PIECES = 1_000_000  # a larger table is joined by shuffling
TASK_WORDS = 8192  # a word has dozens of substrings, which a task sorts by word: so many fit its memory


@dataclass
class Pieces:
    """A model's pieces: text, id and score of the ordinary ones, and the id of byte 0."""

    text: list[str]
    ids: list[int]
    scores: list[float]
    byte_zero: int
    kind: str

    @property
    def longest(self) -> int:
        return max(map(len, self.text), default=1)

    def pairs(self) -> np.ndarray:
        """The pairs of characters that stand next to each other in some piece."""
        return np.array(sorted({(ord(a) << 32) | ord(b) for p in self.text for a, b in zip(p, p[1:], strict=False)}), np.int64)

    def bytes_of(self) -> list[bytes]:
        """What each id decodes to, marks as spaces; ids that are no text give nothing."""
        out = [b""] * (max([*self.ids, self.byte_zero + 255]) + 1)
        for b in range(256):
            out[self.byte_zero + b] = bytes([b])
        for i, p in zip(self.ids, self.text, strict=True):
            out[i] = p.replace(MARK, " ").encode()
        return out


def read_pieces(path: str) -> Pieces:
    """The piece table of a SentencePiece model file with byte fallback."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rows = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
    zero = next(i for i, p in enumerate(model.pieces) if p.piece == "<0x00>")
    kind = {1: "unigram", 2: "bpe"}[model.trainer_spec.model_type]
    return Pieces([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], zero, kind)


class Splitter:
    """Cuts a block's texts into words that no piece crosses."""

    def __init__(self, pairs: np.ndarray) -> None:
        self.pairs = pairs
        low = pairs[((pairs >> 32) < 1024) & ((pairs & 0xFFFFFFFF) < 1024)]
        self.table = np.zeros((1024, 1024), bool)
        self.table[low >> 32, low & 0xFFFFFFFF] = True
        self.power = self.inverse = np.ones(0, np.uint64)

    def split(self, s: Slice) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(marked text of all rows, start and end of each word, its hash, first word of each row)."""
        chars = np.frombuffer(s.data.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32)
        before = np.zeros(len(s.data) + 1, np.int64)
        np.cumsum((s.data & 0xC0) != 0x80, out=before[1:])
        offsets = before[s.offsets]
        full = offsets[1:] > offsets[:-1]
        chars = np.where(chars == 32, np.uint32(ord(MARK)), chars)
        chars = np.insert(chars, offsets[:-1][full], np.uint32(ord(MARK)))
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        n = len(chars)
        cut = np.ones(n, bool)
        a, b = chars[:-1], chars[1:]
        small = (a | b) < 1024
        joined = self.table[a & 1023, b & 1023] & small
        rest = np.flatnonzero(~small)
        key = (a[rest].astype(np.int64) << 32) | b[rest]
        if len(self.pairs):
            joined[rest] = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
        cut[1:] = ~joined
        cut[offsets[:-1][full]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        if len(self.power) < n:
            base = np.full(n, BASE, np.uint64)
            base[:1] = 1
            self.power = np.cumprod(base, dtype=np.uint64)
            base[1:] = pow(BASE, -1, 1 << 64)
            self.inverse = np.cumprod(base, dtype=np.uint64)
        hashes = np.zeros(0, np.uint64)
        if n:
            terms = mix(chars.astype(np.uint64) + np.uint64(0x9E37)) * self.power[:n]
            hashes = mix(np.add.reduceat(terms, start) * self.inverse[start] + (end - start).astype(np.uint64) * seeds(1, 3))
        return chars.tobytes().decode("utf-32-le"), start, end, hashes, np.searchsorted(start, offsets)


def _distinct(s: Slice, splitter: Splitter) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words by hash, their hashes, number of each word, first word of each row)."""
    text, start, end, hashes, first = splitter.split(s)
    names, at, of = np.unique(hashes, return_index=True, return_inverse=True)
    return [text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], names, of, first


def pack_words(words: list[str]) -> bytes:
    raw = "".join(words).encode()
    return shrink(np.array([len(w) for w in words], np.int32), np.frombuffer(raw, np.uint8))


def unpack_words(body: bytes) -> list[str]:
    lengths, raw = expand(body)
    text, cuts = raw.tobytes().decode(), np.concatenate([[0], np.cumsum(lengths)]).tolist()
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def block_words(docs: DataFrame, text_col: str, pairs: np.ndarray, shards: int) -> DataFrame:
    """Messages with each block's distinct words, by shard of their hash; blocks are those of ``pack_rows``."""

    def ask():
        splitter = Splitter(pairs)

        def make(s: Slice) -> list[tuple[int, bytes]]:
            words, names, _, _ = _distinct(s, splitter)
            bounds = shard_bounds(names, shards)
            return [(k, pack_words(words[a:b])) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]

        return make

    return send_rows(docs, text_col, ask, BLOCK_BYTES)


def _sorted_words(bodies: pa.ChunkedArray) -> list[str]:
    found: set[str] = set()
    for body in bodies:  # one message's words at a time: those of all together repeat many times
        found.update(unpack_words(body.as_py()))
    return sorted(found)


def distinct_words(messages: DataFrame) -> DataFrame:
    """(key, word) of all messages; a word has one shard, and its key is shard * 2^32 + its place there."""

    def run(found: pa.Table) -> pa.Table:
        words = _sorted_words(found.column("body"))
        keys = (found.column("shard")[0].as_py() << 32) + np.arange(len(words))
        return pa.table({"key": pa.array(keys), "word": pa.array(words, pa.string())})

    return messages.groupBy("shard").applyInArrow(run, "key long, word string")


def merge_encode(word: str, scores: dict[str, float]) -> list[str]:
    """Segments of one word by merging in order of score, the leftmost of equals first."""
    after = list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    text: list[str | None] = list(word)
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(word) and (s := scores.get(text[i] + text[after[i]])) is not None:
            heapq.heappush(heap, (-s, i, text[i] + text[after[i]]))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, joint = heapq.heappop(heap)
        if text[i] is None or after[i] >= len(word) or text[i] + text[after[i]] != joint:
            continue
        j = after[i]
        text[i], text[j], after[i] = joint, None, after[j]
        if after[i] < len(word):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [t for t in text if t is not None]


def best_path(word: str, scores: dict[str, float], longest: int) -> list[str]:
    """Segments of one word with the highest total score; characters without a piece are far below any."""
    low = min(scores.values(), default=0.0) - 10.0
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        options = []
        for i in range(max(0, j - longest), j):
            s = scores.get(word[i:j], low if j - i == 1 else None)
            if s is not None:
                options.append((best[i][0] + s, -i))
        score, at = max(options)
        best.append((score, -at))
    out, j = [], len(word)
    while j:
        out.append(word[best[j][1] : j])
        j = best[j][1]
    return out[::-1]


def _merge_fold(n: Column, edges: Column) -> Column:
    """Cut points of each word after all merges.

    ``edges`` maps start * 64 + end to rank * 2^20 + id, where a lower rank is a
    better score. Of the options of a step, rank * 64 + place, the smallest wins.
    """

    def step(cuts: Column, _: Column) -> Column:
        def option(i: Column) -> Column:
            return F.shiftright(edges[F.get(cuts, i) * 64 + F.get(cuts, i + 2)], 20) * 64 + i

        best = F.when(F.size(cuts) > 2, F.array_min(F.transform(F.sequence(F.lit(0), F.size(cuts) - 3), option)))
        return let(best, lambda b: F.when(b.isNull(), cuts).otherwise(F.filter(cuts, lambda x, i: i != b % 64 + 1)))

    return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step)


def _viterbi_fold(n: Column, edges: Column, low: float) -> Column:
    """Cut points of the best path; ``edges`` has start, end and score."""
    state = "array<struct<score:double,at:int>>"

    def step(best: Column, j: Column) -> Column:
        options = F.transform(
            F.filter(edges, lambda e: e["end"] == j),
            lambda e: F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("at")),
        )
        lone = F.array(F.struct((F.get(best, j - 1)["score"] + F.lit(low)).alias("score"), (1 - j).alias("at")))
        return F.concat(best, F.array(F.array_max(F.concat(options, lone))))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("at"))).cast(state)

    def walk_back(best: Column) -> Column:
        def back(cuts: Column, _: Column) -> Column:
            at = F.element_at(cuts, -1)
            return F.when(at > 0, F.concat(cuts, F.array(-F.get(best, at)["at"]))).otherwise(cuts)

        return F.reverse(F.aggregate(F.sequence(F.lit(1), n), F.array(n), back))

    return let(F.aggregate(F.sequence(F.lit(1), n), start, step), walk_back)


def encode_words(words: DataFrame, pieces: Pieces, fold: str | None = None) -> DataFrame:
    """(key, ids) of distinct words (key, word); a character without a piece is -1 minus its code point.

    ``fold`` is "viterbi" or "merge", by default what the model's kind calls for.
    """
    fold = fold or ("viterbi" if pieces.kind == "unigram" else "merge")
    spark, longest = words.sparkSession, pieces.longest
    few = len(pieces.text) <= MOST_PIECES
    ranks = {s: r for r, s in enumerate(sorted(set(pieces.scores), reverse=True))}
    rows = [(p, i, s, (ranks[s] << 20) + i) for p, i, s in zip(pieces.text, pieces.ids, pieces.scores, strict=True)]
    table = spark.createDataFrame(rows, "piece string, id int, score double, code long")
    # How long pieces with the same two first characters get; a substring beyond that is none.
    reach: dict[str, int] = {}
    for p in pieces.text:
        reach[p[:2]] = max(reach.get(p[:2], 1), len(p))
    heads = spark.createDataFrame(list(reach.items()) or [("", 1)], "head string, reach int")
    if few:
        table, heads = F.broadcast(table), F.broadcast(heads)
    low = min(pieces.scores, default=0.0) - 10.0
    # A number of its own, since the words look small before their substrings are made.
    tasks = -(-words.count() // TASK_WORDS) or 1
    sized = words.withColumn("n", F.char_length("word")).repartition(tasks, "key")
    spots = sized.filter(f"n <= {LONG}").select("key", "word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    spots = spots.withColumn("head", F.expr("substring(word, start + 1, 2)")).join(heads, "head", "left")
    ends = F.sequence(F.col("start") + 1, F.least(F.col("n"), F.col("start") + F.coalesce("reach", F.lit(1))))
    spans = spots.select("key", "word", "n", "start", F.explode(ends).alias("end"))
    spans = spans.select("key", "n", "start", "end", F.expr("substring(word, start + 1, end - start)").alias("piece"))
    edges = spans.join(table, "piece", "left").filter("id is not null or end = start + 1")
    place = F.col("start") * 64 + F.col("end")
    if fold == "viterbi":
        edge = F.struct("start", "end", "score", F.coalesce("id", -1 - F.ascii("piece")).alias("id"))
        grouped = edges.groupBy("key").agg(F.first("n").alias("n"), F.collect_list(edge).alias("edges"))
        by_span = F.map_from_entries(F.transform("edges", lambda e: F.struct(e["start"] * 64 + e["end"], e["id"])))
        cuts = let(F.filter("edges", lambda e: e["score"].isNotNull()), lambda e: _viterbi_fold(F.col("n"), e, low))
        id_of = lambda code: code
    else:
        # An edge is one number: rank, id, start and end; a lone character has no rank and its code point as id.
        number = F.coalesce("code", F.lit((1 << 40) - (1 << 21)) + F.ascii("piece")) * 4096 + place
        grouped = edges.groupBy("key").agg(F.first("n").alias("n"), F.collect_list(number).alias("edges"))
        by_span = F.map_from_entries(F.transform("edges", lambda e: F.struct((e % 4096).cast("int"), F.shiftright(e, 12))))
        cuts = let(by_span, lambda m: _merge_fold(F.col("n"), m))
        lone = F.lit((1 << 40) - (1 << 21))
        id_of = lambda code: F.when(code >= lone, lone - code - 1).otherwise(code % (1 << 20)).cast("int")
    spans_of = lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda a, i: a * 64 + F.get(c, i + 1))
    ids = let(by_span, lambda m: F.transform(let(cuts, spans_of), lambda k: id_of(m[k])))
    folded = grouped.select("key", ids.alias("ids"))

    scores, numbers = dict(zip(pieces.text, pieces.scores, strict=True)), dict(zip(pieces.text, pieces.ids, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_path(w.as_py(), scores, longest) if fold == "viterbi" else merge_encode(w.as_py(), scores) for w in batch.column(1)]
            coded = pa.array([[numbers.get(t, -1 - ord(t[0])) for t in ts] for ts in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), coded], ["key", "ids"])

    long = sized.filter(f"n > {LONG}").select("key", "word").mapInArrow(run, "key long, ids array<int>")
    return folded.union(long)


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", out_col: str = "piece_ids", fold: str | None = None) -> DataFrame:
    """``docs`` with the piece ids of each text in an array column.

    Null and empty texts have no pieces. The other columns pass through
    whatever their names are; if ``out_col`` is taken, underscores go in front.
    ``docs`` is read twice, which is less to store than its blocks; rows that
    come in another order the second time fail the job.
    """
    out = free_name(docs, out_col)
    shards, pairs, zero = shard_count(docs), pieces.pairs(), pieces.byte_zero
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    # Each step is written before the next, so that a task has one Python worker and steps are not run twice.
    messages = checkpointed(block_words(docs, text_col, pairs, shards))
    words = checkpointed(distinct_words(messages))
    drop_superseded(docs.sparkSession, settle=1.0)
    coded = checkpointed(encode_words(words, pieces, fold).withColumn("shard", F.shiftright("key", 32).cast("int")))
    del words
    drop_superseded(docs.sparkSession, settle=1.0)

    def reply(asked: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("key")
        ids = known.column("ids").combine_chunks()
        flat, cuts = np.asarray(ids.flatten()), np.asarray(ids.offsets) - ids.offsets[0].as_py() if len(ids) else np.zeros(1, int)
        sizes = np.diff(cuts)
        number = {w: i for i, w in enumerate(_sorted_words(asked.column("body")))}
        bodies = []
        for body in asked.column("body"):
            at = np.array([number[w] for w in unpack_words(body.as_py())], np.int64)
            n = sizes[at]
            spots = np.repeat(cuts[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            bodies.append(shrink(n.astype(np.int32), flat[spots].astype(np.int32)))
        return asked.select(["shard", "block"]).append_column("body", pa.array(bodies, pa.binary()))

    answers = checkpointed(messages.groupBy("shard").cogroup(coded.groupBy("shard")).applyInArrow(reply, MESSAGE))
    del messages, coded
    drop_superseded(docs.sparkSession, settle=1.0)

    def finish():
        splitter = Splitter(pairs)

        def make(key: int, s: Slice, replies: dict[int, bytes]) -> pa.Table:
            words, names, of, first = _distinct(s, splitter)
            parts = [expand(replies[k]) for k in sorted(replies)]
            n = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
            flat = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int32)
            if len(n) != len(words):
                raise RuntimeError("a block was recomputed with other rows; run the job again")
            flat, n = _to_bytes(flat, n, zero)
            begin = np.concatenate([[0], np.cumsum(n)])[:-1]
            sizes = n[of]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            spots = np.repeat(begin[of] - ends[:-1], sizes) + np.arange(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends[first].astype(np.int32)), pa.array(flat[spots].astype(np.int32)))
            return pa.Table.from_arrays([*s.batch.columns, lists], [*s.batch.schema.names, out])

        return make

    return with_answers(pack_rows(docs, text_col, BLOCK_BYTES), answers, text_col, finish, schema)


def _to_bytes(flat: np.ndarray, n: np.ndarray, zero: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the bytes' pieces in place of negative code points, and the new length of each word."""
    odd = np.flatnonzero(flat < 0)
    if not len(odd):
        return flat, n
    width = np.ones(len(flat), np.int64)
    code = -1 - flat[odd].astype(np.int64)
    width[odd] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    word = np.repeat(np.arange(len(n)), n)
    out = np.repeat(flat, width)
    first = np.concatenate([[0], np.cumsum(width)])[odd]
    raw = "".join(map(chr, code.tolist())).encode("utf-8", "surrogatepass")
    spots = np.repeat(first - np.concatenate([[0], np.cumsum(width[odd])[:-1]]), width[odd]) + np.arange(width[odd].sum())
    out[spots] = zero + np.frombuffer(raw, np.uint8).astype(out.dtype)
    return out, np.bincount(word, width, len(n)).astype(np.int64)


def decode(docs: DataFrame, pieces: Pieces, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of each id array; null for null.

    A null among the ids, or an id that the model does not have, becomes the
    replacement character. Repeated rows each get their text, an empty table
    stays empty.
    """
    out = free_name(docs, out_col)
    table, names = pieces.bytes_of(), docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch.column(names.index(ids_col)):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                known = [table[i] if i is not None and 0 <= i < len(table) else UNKNOWN for i in ids.as_py()]
                raw = b"".join(known)
                texts.append(raw[1 if raw[:1] == b" " else 0 :].decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    return docs.mapInArrow(run, schema)
