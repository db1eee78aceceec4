"""Deltas between a basis and a source: lookup, coalescing, patching, matching at any offset."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sparksync.functions.content import byte_slice, strong_hash
from sparksync.operators.rolling import match_blocks
from sparksync.operators.signatures import fixed_block_signature, signature_index

LITERAL_BUDGET = 256 << 20


def compute_delta(source_signature: DataFrame, basis_signature: DataFrame) -> DataFrame:
    """One op per source chunk: copy of an equal basis chunk, or literal.

    The lookup key is (path, strong), so the rows of one blob spread over all
    partitions; a chunk repeated in the basis is reduced to its first place.
    """
    index = signature_index(basis_signature).select(
        "path", "strong", F.col("offset").alias("basis_offset")
    )
    ops = source_signature.select("path", "idx", "offset", "len", "strong")
    return ops.join(index, ["path", "strong"], "left").select(
        "path",
        "idx",
        F.when(F.col("basis_offset").isNull(), "literal").otherwise("copy").alias("op"),
        F.col("offset").alias("source_offset"),
        F.col("len").cast("bigint").alias("len"),
        "basis_offset",
    )


def coalesce_ops(ops: DataFrame) -> DataFrame:
    """Merge neighbouring literals, and copies that continue in the basis."""
    order = W.partitionBy("path").orderBy("idx")
    prev_op = F.lag("op").over(order)
    prev_end = F.lag(F.col("basis_offset") + F.col("len")).over(order)
    joins = (prev_op == F.col("op")) & (
        (F.col("op") == "literal") | (prev_end == F.col("basis_offset"))
    )
    runs = ops.withColumn("_starts", F.when(joins, 0).otherwise(1)).withColumn(
        "op_idx", F.sum("_starts").over(order) - 1
    )
    return runs.groupBy("path", "op_idx").agg(
        F.first("op").alias("op"),
        F.min("source_offset").alias("source_offset"),
        F.sum("len").alias("len"),
        F.min("basis_offset").alias("basis_offset"),
    )


def attach_literals(ops: DataFrame, source: DataFrame, content: str = "content") -> DataFrame:
    """Give literal ops their bytes, making the delta independent of the source.

    The ops of a path (at most one blob's worth) are packed into one row and
    meet the content once, however many ops there are; the result stays
    partitioned by path, so a patch that follows does not shuffle again.
    """
    packed = ops.groupBy("path").agg(F.collect_list(F.struct(*[c for c in ops.columns if c != "path"])).alias("_ops"))
    data = source.select("path", F.col(content).cast("binary").alias("_data"))
    rows = packed.join(data, "path").select("path", "_data", F.explode("_ops").alias("_op"))
    piece = byte_slice(F.col("_data"), F.col("_op.source_offset"), F.col("_op.len"))
    return rows.select("path", "_op.*", F.when(F.col("_op.op") == "literal", piece).alias("literal"))


def delta_heads(source: DataFrame, basis: DataFrame, content: str = "content") -> DataFrame:
    """Sizes and the expected checksum per path."""
    size = F.octet_length(F.col(content).cast("binary")).cast("bigint")
    left = source.select(
        "path", size.alias("source_size"), strong_hash(F.col(content).cast("binary")).alias("checksum")
    )
    right = basis.select("path", size.alias("basis_size"))
    return left.join(right, "path", "left").withColumn(
        "basis_size", F.coalesce("basis_size", F.lit(0).cast("bigint"))
    )


def delta_stats(ops: DataFrame) -> DataFrame:
    """Matched and literal bytes per path; they add up to the source size."""
    part = lambda op: F.sum(F.when(F.col("op") == op, F.col("len")).otherwise(0))
    return ops.groupBy("path").agg(
        part("copy").alias("bytes_matched"),
        part("literal").alias("bytes_literal"),
        F.count("*").alias("ops"),
    )


def delta_fallback(
    stats: DataFrame, heads: DataFrame, budget: int = LITERAL_BUDGET, cross_basis: bool = False
) -> DataFrame:
    """Where a whole copy beats the delta: empty basis, too many literals, poor cross match."""
    rule = F.when(F.col("basis_size") == 0, "empty-basis").when(
        F.coalesce("bytes_literal", F.col("source_size")) > budget, "literal-budget"
    )
    if cross_basis:
        matched = F.coalesce("bytes_matched", F.lit(0))
        rule = rule.when(matched * 2 < F.col("source_size"), "dissimilar")
    return heads.join(stats, "path", "left").select(
        "path",
        F.when(rule.isNull(), "delta").otherwise("copy").alias("transfer"),
        rule.alias("fallback_reason"),
    )


def validate_ops(ops: DataFrame, heads: DataFrame) -> DataFrame:
    """Copy ops that reach past the end of their basis."""
    end = F.col("basis_offset") + F.col("len")
    return (
        ops.filter(F.col("op") == "copy")
        .join(heads.select("path", "basis_size"), "path", "left")
        .filter(end > F.coalesce("basis_size", F.lit(0)))
        .select("path", "op_idx", "basis_offset", "len", "basis_size")
    )


def apply_patch(basis: DataFrame, ops: DataFrame, heads: DataFrame, content: str = "content") -> DataFrame:
    """Rebuild the content of every path in ``heads`` from its basis and the delta.

    A source without bytes has no ops and comes out empty. Ops of a path are
    gathered first (at most one blob's worth) and meet the basis once; bytes
    are joined as they are. Blobs too large for a row are patched in pieces,
    see ``blobs.patch_pieces``.
    """
    recipe = ops.groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("op_idx", "op", "basis_offset", "len", "literal"))).alias("ops")
    )
    data = basis.select("path", F.col(content).cast("binary").alias("data"))
    rows = heads.select("path").join(recipe, "path", "left").join(data, "path", "left").select("path", "data", "ops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, parts = memoryview(row["data"] or b""), []
                for o in row["ops"] or []:
                    at = o["basis_offset"]
                    parts.append(data[at : at + o["len"]] if o["op"] == "copy" else o["literal"])
                whole = pa.array([b"".join(parts)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), whole], names=["path", content])

    return rows.mapInArrow(run, f"path string, {content} binary")


def verify_reconstruction(rebuilt: DataFrame, heads: DataFrame, content: str = "content") -> DataFrame:
    """Paths whose rebuilt content has another hash than expected, or is missing."""
    actual = rebuilt.select("path", strong_hash(F.col(content).cast("binary")).alias("actual"))
    return (
        heads.select("path", F.col("checksum").alias("expected"))
        .join(actual, "path", "left")
        .filter(~F.col("actual").eqNullSafe(F.col("expected")))
    )


def delta_between(
    source: DataFrame, basis: DataFrame, block: int | None = None, content: str = "content"
) -> DataFrame:
    """Fixed-block delta of all paths in ``source`` against ``basis``, with literals.

    With a given ``block`` both sides are cut on the same grid. Without one,
    blocks are sized by the basis and found at any source offset; sources
    with no basis content are one literal.
    """
    if block is None:
        usable = basis.filter(F.octet_length(F.col(content).cast("binary")) > 0)
        fresh = source.join(usable.select("path"), "path", "left_anti")
        return sliding_match(source, usable, content=content).unionByName(
            whole_literals(fresh, content)
        )
    wanted = basis.join(source.select("path"), "path", "left_semi")
    ops = compute_delta(
        fixed_block_signature(source, content, block), fixed_block_signature(wanted, content, block)
    )
    return attach_literals(coalesce_ops(ops), source, content)


def whole_literals(source: DataFrame, content: str = "content") -> DataFrame:
    """A delta of one literal per non-empty blob."""
    data = F.col(content).cast("binary")
    return source.filter(F.octet_length(data) > 0).select(
        "path",
        F.lit(0).cast("bigint").alias("op_idx"),
        F.lit("literal").alias("op"),
        F.lit(0).cast("bigint").alias("source_offset"),
        F.octet_length(data).cast("bigint").alias("len"),
        F.lit(None).cast("bigint").alias("basis_offset"),
        data.alias("literal"),
    )


_SLIDE_SCHEMA = (
    "path string, op_idx bigint, op string, source_offset bigint, len bigint, "
    "basis_offset bigint, literal binary"
)


# Literal bytes gathered before a batch of ops is handed on.
_FLUSH_BYTES = 32 << 20


def _slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ops, held = [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            found = _ops_of(row.data, row.weak, row.strong, row.offset, row.len)
            ops.extend((row.path, i, *op) for i, op in enumerate(found))
            held += len(row.data)
            if held > _FLUSH_BYTES:
                yield _ops_frame(ops)
                ops, held = [], 0
    yield _ops_frame(ops)


def _ops_frame(ops: list[tuple]) -> pd.DataFrame:
    names = ["path", "op_idx", "op", "source_offset", "len", "basis_offset", "literal"]
    return pd.DataFrame(ops, columns=names).astype(
        {"op_idx": "int64", "source_offset": "int64", "len": "int64", "basis_offset": "Int64"}
    )


def _ops_of(data, weak, strong, offset, length):
    """Alternate literal gaps and copies, merging copies that continue in the basis."""
    pos, run = 0, None
    hits = match_blocks(data, np.asarray(weak), np.asarray(strong, dtype=object), np.asarray(offset), np.asarray(length))
    for at, n, basis in hits:
        if run and at == pos and run[3] + run[2] == basis:
            run[2] += n
        else:
            if run:
                yield tuple(run)
            if at > pos:
                yield ("literal", pos, at - pos, None, data[pos:at])
            run = ["copy", at, n, basis, None]
        pos = at + n
    if run:
        yield tuple(run)
    if pos < len(data):
        yield ("literal", pos, len(data) - pos, None, data[pos:])


def sliding_match(
    source: DataFrame, basis: DataFrame, block: int | None = None, content: str = "content"
) -> DataFrame:
    """Fixed basis blocks found at any byte offset of the source, as delta ops with literals.

    The basis signature of a path is packed into one row and joined with the
    source blob, so Spark distributes by path and a task holds one pair at a
    time. Sources without a basis are left out.
    """
    sig = fixed_block_signature(basis.join(source.select("path"), "path", "left_semi"), content, block, weak=True)
    packed = sig.groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("idx", "offset", "len", "weak", "strong"))).alias("_b")
    )
    pairs = source.select("path", F.col(content).cast("binary").alias("data")).join(packed, "path").select(
        "path", "data", *[F.col(f"_b.{c}").alias(c) for c in ("weak", "strong", "offset", "len")]
    )
    return pairs.mapInPandas(_slide, _SLIDE_SCHEMA)
