"""Large blobs as tables of pieces, so that many tasks work on one blob.

A blob is rows of (path, seq, offset, bytes): equal pieces, the last one may
be shorter, an empty blob is one empty piece. Tasks read a piece with a few
bytes of its neighbours; places where a chunk may end, or where a basis block
is found, do not depend on anything before. What remains in order, the choice
among those places, is made per blob on their offsets alone, about a thousandth
of the blob's size.

Pieces are keyed by (path, seq), so one blob spreads over all partitions.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparksync.functions.content import byte_slice, strong_hash
from sparksync.operators.rolling import GEAR_SPAN, choose_cuts, cut_places, cut_places_of_many, weak_at, window_names

PIECE = 1 << 20
#: No block is longer, see ``auto_block_size``.
LONGEST_BLOCK = 32768
#: Small pieces are worked on together, up to so many bytes.
TOGETHER = 1 << 18
BLOB = "path string, seq long, offset long, bytes binary"


def to_pieces(df: DataFrame, content: str = "content", size: int = PIECE) -> DataFrame:
    """Whole blobs, as rows hold them, cut into pieces of ``size`` bytes."""
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    last = F.greatest(F.ceil(F.octet_length(data) / size) - 1, F.lit(0)).cast("long")
    rows = df.select("path", data.alias("data"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq"))
    return rows.select("path", "seq", (F.col("seq") * size).alias("offset"), byte_slice(F.col("data"), F.col("seq") * size, F.lit(size)).alias("bytes"))


def from_pieces(pieces: DataFrame, content: str = "content") -> DataFrame:
    """(path, content), where blobs are small enough to be rows."""
    rows = pieces.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("offset", "bytes"))).alias("parts"))
    return _joined(rows.select("path", F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("offset"), "parts")).select("path", F.col("bytes").alias(content))


def _joined(rows: DataFrame) -> DataFrame:
    """(path, seq, offset, bytes) from parts of (offset, bytes) that must follow each other from the row's ``offset``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(batches):
            data = []
            for row in rows:
                at = row["offset"]
                for part in row["parts"]:
                    if part["offset"] != at:
                        raise ValueError(f"{row['path']}: nothing for the bytes from {at}")
                    at += len(part["bytes"])
                data.append(b"".join(p["bytes"] for p in row["parts"]))
            yield pa.RecordBatch.from_arrays([*([r[c] for r in rows] for c in ("path", "seq", "offset")), pa.array(data, pa.binary())], schema=blob)

    blob = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("offset", pa.int64()), ("bytes", pa.binary())])
    return rows.mapInArrow(run, BLOB)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows in lists of about ``TOGETHER`` bytes, single ones where rows are large."""
    for batch in batches:
        step = max(TOGETHER * batch.num_rows // max(batch.nbytes, 1), 1)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step).to_pylist()


def _per_path(rows: DataFrame, order: str, make: Callable[[list[dict]], list[tuple]], kinds: pa.Schema, schema: str) -> DataFrame:
    """What ``make`` gives for the rows of each path, which come in the order of ``order``.

    A partition holds whole paths, sorted, and is read as one stream, so that
    a short path does not cost a call with frames of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["path"] != row["path"]:
                    out += make(held)
                    held = []
                    if len(out) >= 10_000:
                        yield packed(out)
                        out = []
                held.append(row)
        out += make(held) if held else []
        if out:
            yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    return rows.repartition("path").sortWithinPartitions("path", order).mapInArrow(run, schema)


def with_neighbours(pieces: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Pieces with ``lead``, the last bytes of the piece before, and ``tail``, the first bytes of the piece after."""
    out = pieces
    if before:
        last = F.substring("bytes", F.greatest(F.octet_length("bytes") - before, F.lit(0)) + 1, F.lit(before))
        out = out.join(pieces.select("path", (F.col("seq") + 1).alias("seq"), last.alias("lead")), ["path", "seq"], "left")
    if after:
        first = F.substring("bytes", F.lit(1), F.lit(after))
        out = out.join(pieces.filter("seq > 0").select("path", (F.col("seq") - 1).alias("seq"), first.alias("tail")), ["path", "seq"], "left")
    return out


def cut_spans(pieces: DataFrame, min_size: int, avg_size: int, max_size: int) -> DataFrame:
    """(path, idx, offset, len) of the content-defined chunks, the same as of the blob in one row."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(batches):
            leads = [row["lead"] or b"" for row in rows]
            data, skips = [lead + row["bytes"] for lead, row in zip(leads, rows, strict=True)], list(map(len, leads))
            # One large piece is hashed window by window.
            ends = cut_places_of_many(data, skips, avg_size) if len(data) > 1 else [cut_places(data[0], avg_size, skips[0])]
            hard, easy = ([e[k] + row["offset"] for e, row in zip(ends, rows, strict=True)] for k in (0, 1))
            columns = [[r["path"] for r in rows], [r["offset"] for r in rows], [len(r["bytes"]) for r in rows], hard, easy]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, found.types, strict=True)], schema=found)

    ints = pa.list_(pa.int64())
    found = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("hard", ints), ("easy", ints)])

    def choose(rows: list[dict]) -> list[tuple]:
        hard, easy = ([end for row in rows for end in row[c]] for c in ("hard", "easy"))
        ends = choose_cuts(sum(row["size"] for row in rows), hard, easy, min_size, avg_size, max_size)
        return [(rows[0]["path"], i, begin, end - begin) for i, (begin, end) in enumerate(zip([0, *ends], ends))]

    spans = pa.schema([("path", pa.string()), ("idx", pa.int32()), ("offset", pa.int64()), ("len", pa.int32())])
    marked = with_neighbours(pieces, before=GEAR_SPAN - 1).mapInArrow(places, "path string, offset long, size long, hard array<long>, easy array<long>")
    return _per_path(marked, "offset", choose, spans, "path string, idx int, offset long, len int")


def cdc_chunks_of_pieces(pieces: DataFrame, min_size: int, avg_size: int, max_size: int, size: int = PIECE) -> DataFrame:
    """Content-defined chunks of blobs in pieces, with their strong hash: (path, idx, offset, len, strong)."""
    if max_size > size:
        raise ValueError("a chunk must not be longer than a piece")
    spans = cut_spans(pieces, min_size, avg_size, max_size)
    held = spans.groupBy("path", F.floor(F.col("offset") / size).cast("long").alias("seq")).agg(F.collect_list(F.struct("idx", "offset", "len")).alias("spans"))
    rows = with_neighbours(pieces, after=max_size).join(held, ["path", "seq"])
    data = F.when(F.col("tail").isNull(), F.col("bytes")).otherwise(F.concat("bytes", "tail"))
    rows = rows.select("path", F.col("offset").alias("base"), data.alias("data"), F.explode("spans").alias("s"))
    return rows.select(
        "path", "s.idx", "s.offset", "s.len", strong_hash(byte_slice(F.col("data"), F.col("s.offset") - F.col("base"), F.col("s.len"))).alias("strong")
    )


def sliding_ops(source: DataFrame, signature: DataFrame, longest: int = LONGEST_BLOCK) -> DataFrame:
    """Fixed basis blocks found at any offset of blobs in pieces: (path, op_idx, op, source_offset, len, basis_offset).

    ``signature`` has (path, idx, offset, len, weak, strong) of the basis, on
    one grid per path; of equal blocks the last one is taken. A piece's task
    finds every offset at which a block lies, so nothing depends on what was
    matched before; the leftmost matches without overlap are then picked per
    blob. Equal windows are hashed once, and neighbouring hits on the same
    block are one range, so long runs of equal bytes stay short. Sources
    without a signature are left out.
    """
    packed = signature.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("idx", "offset", "len", "weak", "strong"))).alias("blocks"))
    totals = source.groupBy("path").agg(F.sum(F.octet_length("bytes")).alias("total"))
    known = packed.join(totals, "path")
    rows = with_neighbours(source, after=longest - 1).join(known, "path")

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(batches):
            yield pa.RecordBatch.from_pylist([_hits(row) for row in rows], schema=found)

    ints = pa.list_(pa.int64())
    found = pa.schema([("path", pa.string()), ("total", pa.int64()), ("block", pa.int64()), ("low", ints), ("high", ints), ("basis", ints), ("end_at", pa.int64()), ("end_basis", pa.int64())])
    places = rows.mapInArrow(hits, "path string, total long, block long, low array<long>, high array<long>, basis array<long>, end_at long, end_basis long")
    ops = pa.schema([("path", pa.string()), ("op_idx", pa.int64()), ("op", pa.string()), ("source_offset", pa.int64()), ("len", pa.int64()), ("basis_offset", pa.int64())])
    return _per_path(places, "low", _pick, ops, "path string, op_idx long, op string, source_offset long, len long, basis_offset long")


def _hits(row: dict) -> dict:
    """Ranges of offsets of one piece at which a full basis block begins, and whether the blob ends with the basis' short last block."""
    data, base, total = row["bytes"] + (row["tail"] or b""), row["offset"], row["total"]
    blocks = row["blocks"]
    block, last = blocks[0]["len"], blocks[-1]
    by_hash = {(b["strong"], b["len"]): b["offset"] for b in blocks}
    out = {"path": row["path"], "total": total, "block": block, "low": [], "high": [], "basis": [], "end_at": None, "end_basis": None}
    weak = np.unique([b["weak"] for b in blocks if b["len"] == block])
    at = np.flatnonzero(np.isin(weak_at(np.frombuffer(data, np.uint8), block), weak))
    at = at[at < len(row["bytes"])]
    if len(at):
        names = window_names(np.frombuffer(data, np.uint8), block)[at]
        _, first, which = np.unique(names, axis=0, return_index=True, return_inverse=True)
        places = [by_hash.get((hashlib.sha256(data[i : i + block]).hexdigest(), block), -1) for i in at[first].tolist()]
        basis = np.array(places, np.int64)[which.reshape(-1)]
        at, basis = at[basis >= 0], basis[basis >= 0]
        new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(basis, prepend=-1) != 0))
        stop = np.append(new[1:], len(at)) - 1 if len(new) else new
        out |= {"low": at[new] + base, "high": at[stop] + base, "basis": basis[new]}
    rest = total - last["len"] - base
    if last["len"] < block and 0 <= rest < max(len(row["bytes"]), 1):
        place = by_hash.get((hashlib.sha256(data[rest : rest + last["len"]]).hexdigest(), last["len"]))
        if place is not None:
            out |= {"end_at": rest + base, "end_basis": place}
    return out


def _pick(rows: list[dict]) -> list[tuple]:
    """Leftmost hits without overlap, as alternating literals and copies; copies that go on in the basis are one."""
    hits = sorted((hit for r in rows for hit in zip(r["low"], r["high"], r["basis"], strict=True)), key=lambda hit: hit[0])
    low, high, basis = zip(*hits, strict=True) if hits else ((), (), ())
    total, block = rows[0]["total"], rows[0]["block"]
    ops: list[list] = []

    def copy(at: int, n: int, place: int) -> None:
        done = ops[-1][1] + ops[-1][2] if ops else 0
        if ops and at == done and ops[-1][0] == "copy" and ops[-1][3] + ops[-1][2] == place:
            ops[-1][2] += n
            return
        if at > done:
            ops.append(["literal", done, at - done, None])
        ops.append(["copy", at, n, place])

    pos, i = 0, 0
    while True:
        i = bisect_left(high, pos, i)
        if i >= len(low):
            break
        at = max(low[i], pos)
        copy(at, block, basis[i])
        pos = at + block
    ends = [(r["end_at"], r["end_basis"]) for r in rows if r["end_at"] is not None]
    # A rest shorter than a block can only be the basis' own short last block.
    if ends and ends[0][0] == pos:
        copy(pos, total - pos, ends[0][1])
        pos = total
    if pos < total:
        ops.append(["literal", pos, total - pos, None])
    return [(rows[0]["path"], i, *op) for i, op in enumerate(ops)]


def literal_pieces(ops: DataFrame, source: DataFrame, size: int = PIECE) -> DataFrame:
    """Ops with the bytes of literals, which are cut where the source's pieces end."""
    # Copies keep their row with no part, so that the ops are made once and not for each kind.
    first, last = (F.floor(at / size).cast("long") for at in (F.col("source_offset"), F.col("source_offset") + F.col("len") - 1))
    part = F.when(F.col("op") == "copy", F.array(F.lit(None).cast("long"))).when((F.col("op") == "literal") & (F.col("len") > 0), F.sequence(first, last))
    cols = ["path", "op_idx", "op", "source_offset", "len", "basis_offset"]
    held = ops.select(*cols, F.explode(part).alias("part")).join(source.select("path", F.col("seq").alias("part"), "bytes"), ["path", "part"], "left")
    held = held.filter("op = 'copy' or bytes is not null")
    is_copy, edge = F.col("op") == "copy", F.col("part") * size
    begin = F.when(is_copy, F.col("source_offset")).otherwise(F.greatest("source_offset", edge))
    end = F.when(is_copy, F.col("source_offset") + F.col("len")).otherwise(F.least(F.col("source_offset") + F.col("len"), edge + size))
    return held.select(
        "path", "op_idx", "op", begin.alias("source_offset"), (end - begin).alias("len"), (F.col("basis_offset") + begin - F.col("source_offset")).alias("basis_offset"),
        F.when(~is_copy, byte_slice(F.col("bytes"), begin - edge, end - begin)).alias("literal"),
    )


def _cut_ranges(ops: DataFrame, at: str, size: int) -> DataFrame:
    """Ops cut at multiples of ``size`` of the column ``at``, with the number ``part`` of the multiple."""
    part = F.explode(F.sequence(F.floor(F.col(at) / size).cast("long"), F.floor((F.col(at) + F.col("len") - 1) / size).cast("long")))
    rows = ops.filter("len > 0").withColumn("part", part)
    begin = F.greatest(F.col(at), F.col("part") * size)
    end = F.least(F.col(at) + F.col("len"), (F.col("part") + 1) * size)
    skip = begin - F.col(at)
    return rows.select(
        *[c for c in rows.columns if c not in ("source_offset", "basis_offset", "len", "literal")],
        (F.col("source_offset") + skip).alias("source_offset"), (F.col("basis_offset") + skip).alias("basis_offset"), (end - begin).alias("len"),
        *([byte_slice(F.col("literal"), skip, end - begin).alias("literal")] if "literal" in ops.columns else []),
    )


def patch_pieces(basis: DataFrame, ops: DataFrame, heads: DataFrame, size: int = PIECE) -> DataFrame:
    """The pieces of every path in ``heads``, rebuilt from the pieces of its basis and the delta.

    ``ops`` has literals with their bytes, whole or in parts; ``heads`` has
    (path, source_size) and decides which paths come out, empty ones too.
    Ranges are cut where pieces of the result and of the basis end, so tasks
    hold pieces and never a blob. A range that nothing gives fails the job.
    """
    wanted = ops.join(heads.select("path"), "path", "left_semi").withColumn("literal", F.when(F.col("op") == "literal", F.col("literal")))
    cut = _cut_ranges(wanted, "source_offset", size).withColumnRenamed("part", "seq")
    copies = _cut_ranges(cut.filter("op = 'copy'"), "basis_offset", size)
    found = copies.join(basis.select("path", F.col("seq").alias("part"), "bytes"), ["path", "part"])
    copied = found.select("path", "seq", "source_offset", byte_slice(F.col("bytes"), F.col("basis_offset") - F.col("part") * size, F.col("len")).alias("bytes"))
    given = cut.filter("op = 'literal'").select("path", "seq", "source_offset", F.col("literal").alias("bytes"))
    parts = copied.unionByName(given).groupBy("path", "seq").agg(F.sort_array(F.collect_list(F.struct(F.col("source_offset").alias("offset"), "bytes"))).alias("parts"))
    last = F.greatest(F.ceil(F.col("source_size") / size) - 1, F.lit(0)).cast("long")
    due = heads.select("path", "source_size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq"))
    whole = due.join(parts, ["path", "seq"], "left").withColumn("offset", F.col("seq") * size)
    none = F.array().cast("array<struct<offset:bigint,bytes:binary>>")
    held = F.aggregate(F.coalesce("parts", none), F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["bytes"]))
    short = F.raise_error(F.concat(F.lit("bytes are missing in "), F.col("path"), F.lit(" from "), F.col("offset").cast("string")))
    checked = F.when(held == F.least(F.col("source_size") - F.col("offset"), F.lit(size)), F.coalesce("parts", none)).otherwise(short.cast("array<struct<offset:bigint,bytes:binary>>"))
    return _joined(whole.select("path", "seq", "offset", checked.alias("parts")))
