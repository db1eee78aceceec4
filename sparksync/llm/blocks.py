"""Blocks of rows that ask shards about hashed entries and get compact answers.

Some operators need a corpus-wide fact about millions of small entries (byte
windows, word pairs). One row per entry would cost many times the corpus in
shuffles. Here a task packs its rows into blocks of a few megabytes. A block
sends each shard one message, the distinct entries of that shard as sorted and
compressed arrays. A shard answers every block's message, and a block with its
answers makes its result. Entries are spread by their hash and are distinct
within a block, so a frequent entry costs a shard one entry per block.

A block's key is a digest of its rows. If a lost task is recomputed with its
rows in another order, keys and answers differ and the job fails instead of
mixing them up.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from sparksync.llm.text import Slice, buffers, slices

BLOCK_BYTES = 4 << 20


def packed(batches: Iterator[pa.RecordBatch], text_col: str, block_bytes: int) -> Iterator[tuple[int, bytes, Slice]]:
    """The blocks of a task's rows: key, compressed rows with all their columns, and the slice they come from."""
    for s in slices(batches, text_col, block_bytes):
        sink = pa.BufferOutputStream()
        # A plain copy, so that the bytes do not depend on where the batch was cut.
        batch = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in s.batch.columns], schema=s.batch.schema)
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        payload = sink.getvalue().to_pybytes()
        yield int.from_bytes(hashlib.blake2b(payload, digest_size=8).digest(), "little", signed=True), payload, s


def pack_rows(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, payload): the rows with all their columns, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, payload, _ in packed(batches, text_col, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([payload], pa.binary())], ["block", "payload"])

    return docs.mapInArrow(run, "block long, payload binary")


def open_block(payload: bytes, text_col: str) -> Slice:
    batch = pa.ipc.open_stream(payload).read_next_batch()
    offsets, data = buffers(batch.column(batch.schema.get_field_index(text_col)))
    return Slice(batch, text_col, 0, batch.num_rows, offsets, data)


def shrink(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; each is stored by byte planes, whose high ones are nearly empty."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else np.zeros(0, np.uint8)
        packed = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
        parts += [struct.pack("<cqq", a.dtype.char.encode(), len(a), len(packed)), packed]
    return b"".join(parts)


def expand(body: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(body):
        kind, n, size = struct.unpack_from("<cqq", body, at)
        at += struct.calcsize("<cqq")
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[at : at + size], max_output_size=n * dtype.itemsize or 1), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).ravel() if n else np.zeros(0, dtype))
        at += size
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    """First value and differences of a sorted array."""
    return np.diff(x, prepend=x.dtype.type(0))


def undo_deltas(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)


def shard_bounds(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of sorted 64-bit hashes begins, and the end."""
    edges = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def message_batch(block: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([b for _, b in parts], pa.binary())],
        ["shard", "block", "body"],
    )


MESSAGE = "shard int, block long, body binary"


def send(blocks: DataFrame, text_col: str, make: Callable[[], Callable[[Slice], list[tuple[int, bytes]]]]) -> DataFrame:
    """The messages of every block; ``make`` is called once per task and returns the maker of (shard, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = make()
        for batch in batches:
            for key, payload in zip(batch.column(0), batch.column(1), strict=True):
                yield message_batch(key.as_py(), maker(open_block(payload.as_py(), text_col)))

    return blocks.select("block", "payload").mapInArrow(run, MESSAGE)


def send_rows(docs: DataFrame, text_col: str, make: Callable[[], Callable[[Slice], list[tuple[int, bytes]]]], block_bytes: int) -> DataFrame:
    """The messages of the blocks that ``pack_rows`` makes of ``docs``, without the blocks, in one Python worker a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = make()
        for key, _, s in packed(batches, text_col, block_bytes):
            yield message_batch(key, maker(s))

    return docs.mapInArrow(run, MESSAGE)


def answer(messages: DataFrame, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """The shards' answers to all messages, as (shard, block, body); what goes to a negative shard comes back as it is."""

    def run(found: pa.Table) -> pa.Table:
        bodies = [b.as_py() for b in found.column("body")]
        if found.column("shard")[0].as_py() >= 0:
            bodies = reply(bodies)
        return found.select(["shard", "block"]).append_column("body", pa.array(bodies, pa.binary()))

    return messages.groupBy("shard").applyInArrow(run, MESSAGE)


def with_answers(
    blocks: DataFrame, answers: DataFrame, text_col: str, make: Callable[[], Callable[[int, Slice, dict[int, bytes]], pa.Table]], schema
) -> DataFrame:
    """Each block together with its answers by shard, turned into rows of ``schema``."""
    state: dict = {}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if "maker" not in state:
            state["maker"] = make()
        if not left.num_rows:
            raise RuntimeError("a block was recomputed with other rows; run the job again")
        replies = {k.as_py(): b.as_py() for k, b in zip(right.column("shard"), right.column("body"), strict=True)}
        key = left.column("block")[0].as_py()
        # Equal blocks have equal answers.
        return pa.concat_tables([state["maker"](key, open_block(p.as_py(), text_col), replies) for p in left.column("payload")])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def shard_count(docs: DataFrame, per_partition: float = 0.5) -> int:
    """Shards by the number of scan partitions, whose size Spark bounds."""
    return max(8, int(docs.rdd.getNumPartitions() * per_partition))
