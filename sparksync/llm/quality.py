"""Document quality from random-indexing word vectors and a small network.

Every word has a hashed index vector with ``NONZERO`` entries of +1 or -1. A
word's vector is the sum of the index vectors of its neighbours, over all texts
of the corpus. Words are hashed into ``BUCKETS`` rows, so that the vectors are
one table of fixed size; tasks add up their own table and the sums meet in two
steps. A document is pooled to the mean and the spread of its words' vectors
and the share of different words. A two-layer network gives logits, and a
temperature fitted on rows that the weights have not seen turns them into
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparksync.llm.labelled import fit_sample, fold
from sparksync.llm.text import NOT_ALNUM, Hasher, Slice, Words, seeds, slices

FIT_ROWS = 20_000
BUCKETS = 1 << 14
DIM = 32
NONZERO = 2
REACH = 2  # neighbours to either side
HIDDEN = 32
EPOCHS = 30
CHUNKS = 64
MARKS = bytes(b for b in range(256) if b not in NOT_ALNUM or b in b" \t\n\r\v\f")


def tokens(s: Slice, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every run of letters and digits and every run of other signs, in order."""
    parts = [Words(s.data, s.offsets, separators) for separators in (NOT_ALNUM, MARKS)]
    starts = np.concatenate([w.start for w in parts])
    hashes = np.concatenate([hasher.words(s.data, w) for w in parts])
    order = np.argsort(starts)
    return (hashes[order] % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([w.doc for w in parts])[order]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of each bucket's entries."""
    x = seeds(BUCKETS * NONZERO, 41).reshape(BUCKETS, NONZERO)
    return (x % np.uint64(DIM)).astype(np.int64), 1.0 - 2.0 * ((x >> np.uint64(32)) & np.uint64(1)).astype(float)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The vectors of all buckets at length 1, learned from every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(lower=False), np.zeros(BUCKETS * DIM)
        place, sign = index_vectors()
        for s in slices(batches, text_col):
            bucket, row = tokens(s, hasher)
            for k in range(1, REACH + 1):
                near = row[k:] == row[:-k]
                a, b = bucket[:-k][near], bucket[k:][near]
                for left, right in ((a, b), (b, a)):
                    for j in range(NONZERO):
                        total += np.bincount(left * DIM + place[right, j], sign[right, j], BUCKETS * DIM)
        parts = [c.astype(np.float64).tobytes() for c in np.split(total, CHUNKS)]
        salt = int(abs(total).sum()) % 32
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()), pa.array(parts, pa.binary())], ["chunk", "salt", "body"])

    def add(found: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b.as_buffer()) for b in found.column("body")], axis=0)
        return found.slice(0, 1).select(["chunk", "salt"]).append_column("body", pa.array([total.tobytes()], pa.binary()))

    schema = "chunk int, salt int, body binary"
    sums = docs.select(text_col).mapInArrow(run, schema).groupBy("chunk", "salt").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    table = np.zeros((CHUNKS, BUCKETS * DIM // CHUNKS))
    for r in sums.collect():  # CHUNKS rows, together BUCKETS x DIM numbers
        table[r.chunk] = np.frombuffer(r.body)
    table = table.reshape(BUCKETS, DIM)
    return (table / np.maximum(np.sqrt((table**2).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def pooled(s: Slice, hasher: Hasher, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each row's word vectors, share of different words, log of their number."""
    bucket, row = tokens(s, hasher)
    n = np.bincount(row, minlength=s.n)
    size = np.maximum(n, 1)[:, None]
    full = np.flatnonzero(n)
    first = np.concatenate([[0], np.cumsum(n)])[:-1][full]
    mean, square = np.zeros((s.n, DIM)), np.zeros((s.n, DIM))
    if len(bucket):
        chosen = vectors[bucket]
        mean[full] = np.add.reduceat(chosen, first, axis=0, dtype=np.float64)
        square[full] = np.add.reduceat(chosen * chosen, first, axis=0, dtype=np.float64)
    mean /= size
    spread = np.sqrt(np.maximum(square / size - mean**2, 0))
    kinds = np.bincount(np.unique(row * BUCKETS + bucket) // BUCKETS, minlength=s.n)
    return np.hstack([mean, spread, kinds[:, None] / size, np.log1p(n)[:, None]])


class Network:
    """x -> tanh(x A + a) B + b, with standardised inputs and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.shift) / self.scale
        order = rng.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        d = x.shape[1]
        w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        step = 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(used), max(1, len(used) // 256)):
                h = np.tanh(x[at] @ w[0] + w[1])
                p = 1 / (1 + np.exp(-(h @ w[2] + w[3])))
                e = (p - y[at]) / max(1, len(at))
                back = e[:, None] * w[2] * (1 - h**2)
                grads = [x[at].T @ back + 1e-4 * w[0], back.sum(0), h.T @ e + 1e-4 * w[2], np.array([e.sum()])]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g**2
                    w[i] = w[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w = w
        z, t = self._logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
        loss = [np.mean(np.logaddexp(0, z / k) - t * z / k) if len(held) else 0.0 for k in grid]
        self.temperature = float(grid[int(np.argmin(loss))]) if len(held) else 1.0

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.shift) / self.scale) / self.temperature, -30, 30)))


def quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, rows: int = FIT_ROWS
) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``.

    The network is fitted on at most ``rows`` labelled rows outside the held-out
    fold. Null and empty texts are pooled to zeros and scored like any other. A
    row without an id is scored, and held_out is null there. Without labels of
    both kinds every score is the share of label 1 among the labels, or 0.5.
    Repeated rows get equal scores. Other columns are not read.
    """
    vectors = word_vectors(docs, text_col)
    sample = fit_sample(docs, labels, label, rows, id_col, text_col)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=False)
        for s in slices(batches, "text", 1 << 20):
            x = pooled(s, hasher, vectors)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), s.column("label")], ["x", "y"])

    found = sample.mapInArrow(features, "x array<double>, y int").collect()  # at most ``rows``
    x, y = np.array([r.x for r in found], float), np.array([r.y for r in found], float)
    order = np.lexsort((y, *x.T)) if len(x) else []
    network = Network(x[order], y[order]) if len(set(y.tolist())) > 1 else None
    flat = float(y.mean()) if len(y) else 0.5
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=False)
        for s in slices(batches, text_col, 1 << 20):
            score = network.score(pooled(s, hasher, vectors)) if network else np.full(s.n, flat)
            yield pa.RecordBatch.from_arrays([s.column(id_col), pa.array(score)], [id_col, "score"])

    scored = docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double")
    return scored.select(id_col, (fold(id_col, 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
