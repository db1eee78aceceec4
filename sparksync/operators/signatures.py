"""Chunk signatures: fixed blocks, content-defined chunks, text segments, corpus dedup.

Python only computes numbers (a weak sum, cut offsets). Slicing and strong
hashing stay in the JVM, and no step here shuffles except the aggregations.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from sparksync.functions.binding import let
from sparksync.functions.content import auto_block_size, byte_slice, strong_hash
from sparksync.operators.rolling import gear_cuts, weak_sum, weak_sums

CDC_MIN, CDC_AVG, CDC_MAX = 4 << 10, 16 << 10, 64 << 10


@F.pandas_udf(LongType())
def _weak(data: pd.Series) -> pd.Series:
    return data.map(weak_sum, na_action="ignore")


@F.pandas_udf(ArrayType(LongType()))
def _weak_blocks(data: pd.Series, block: pd.Series) -> pd.Series:
    return pd.Series([weak_sums(d, int(b)) for d, b in zip(data, block)])


def weak_checksum(data: Column) -> Column:
    """Weak sum of each binary value: low half the byte sum, high half the position-weighted sum."""
    return _weak(data)


def fixed_block_signature(
    df: DataFrame, content: str = "content", block: int | None = None, weak: bool = False
) -> DataFrame:
    """One row per block of each blob: idx, offset, len, strong (and weak).

    ``block=None`` sizes the blocks by the blob. An empty blob has no blocks.
    """
    data = F.col(content).cast("binary")
    blobs = df.select(
        "path",
        data.alias("_data"),
        F.octet_length(data).cast("bigint").alias("_size"),
    ).withColumn("_block", auto_block_size(F.col("_size")) if block is None else F.lit(block))
    last = F.floor((F.col("_size") - 1) / F.col("_block")).cast("int")
    blobs = blobs.filter("_size > 0")
    if weak:
        # One call per blob; after the explode the blob would go to Python once per block.
        blobs = blobs.withColumn("_weak", _weak_blocks("_data", "_block"))
        at = F.posexplode("_weak").alias("idx", "weak")
    else:
        at = F.explode(F.sequence(F.lit(0), last)).alias("idx")
    blocks = blobs.select("path", "_data", "_size", "_block", at)
    offset = F.col("idx").cast("bigint") * F.col("_block")
    sliced = blocks.select(
        "path",
        "idx",
        offset.alias("offset"),
        F.least(F.col("_block").cast("bigint"), F.col("_size") - offset).cast("int").alias("len"),
        byte_slice(F.col("_data"), offset, F.col("_block")).alias("_piece"),
        *(["weak"] if weak else []),
    )
    out = sliced.withColumn("strong", strong_hash(F.col("_piece"))).drop("_piece")
    return out.select("path", "idx", "offset", "len", "strong", *(["weak"] if weak else []))


def cdc_chunks(
    df: DataFrame,
    content: str = "content",
    min_size: int = CDC_MIN,
    avg_size: int = CDC_AVG,
    max_size: int = CDC_MAX,
) -> DataFrame:
    """Content-defined chunks that tile each blob, with their strong hash.

    A cut depends on the last 64 bytes only, so boundaries re-align soon after
    an edit. Chunks are ``min_size .. max_size`` long, the last may be shorter.
    """

    @F.pandas_udf(ArrayType(LongType()))
    def cuts(data: pd.Series) -> pd.Series:
        return data.map(lambda b: gear_cuts(b, min_size, avg_size, max_size))

    data = F.col(content).cast("binary")
    blobs = df.select("path", data.alias("_data")).filter(F.octet_length("_data") > 0)
    ends = blobs.withColumn("_cuts", cuts("_data"))
    spans = F.transform(
        F.col("_cuts"),
        lambda end, i: F.struct(
            F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(F.col("_cuts"), i - 1)).alias("offset"),
            end.alias("end"),
        ),
    )
    chunks = ends.select("path", "_data", F.posexplode(spans).alias("idx", "_span"))
    length = F.col("_span.end") - F.col("_span.offset")
    return chunks.select(
        "path",
        "idx",
        F.col("_span.offset").alias("offset"),
        length.cast("int").alias("len"),
        strong_hash(byte_slice(F.col("_data"), F.col("_span.offset"), length)).alias("strong"),
    )


def text_cdc_segments(
    df: DataFrame, text: str = "text", mask: str = "0", keep: list[str] = ()
) -> DataFrame:
    """Cut a text after each word whose md5 starts with ``mask``; segments tile the words.

    Everything happens inside the row with array functions: a row's words
    never leave it, so there is no shuffle.
    """
    ends = lambda words: F.filter(
        F.sequence(F.lit(1), F.size(words)),
        lambda i: (i == F.size(words)) | F.md5(F.element_at(words, i)).startswith(mask),
    )
    start = lambda ends, i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
    piece = lambda words, ends, end, i: F.struct(
        (end - start(ends, i)).alias("n_words"),
        F.array_join(F.slice(words, start(ends, i) + 1, end - start(ends, i)), " ").alias("piece"),
    )
    segments = let(
        F.split(F.col(text), " "),
        lambda words: let(
            ends(words),
            lambda cuts: F.transform(cuts, lambda end, i: piece(words, cuts, end, i)),
        ),
    )
    data = F.col("_seg.piece").cast("binary")
    return df.select(*keep, F.posexplode(segments).alias("idx", "_seg")).select(
        *keep,
        "idx",
        F.col("_seg.n_words").alias("n_words"),
        F.octet_length(data).cast("bigint").alias("len"),
        strong_hash(data).alias("strong"),
    )


def signature_index(signature: DataFrame) -> DataFrame:
    """The first chunk of each (path, strong)."""
    first = F.min(F.struct("offset", "len")).alias("first")
    return signature.groupBy("path", "strong").agg(first).select(
        "path", "strong", F.col("first.offset").alias("offset"), F.col("first.len").alias("len")
    )


def chunk_dedup_report(chunks: DataFrame, group: str = "source") -> DataFrame:
    """Per group: chunks, distinct chunks, duplicate bytes, and bytes another group holds too.

    Chunks are first counted per (hash, group) with map-side combine, so a
    very common chunk or a dominant group is one row per task before the
    shuffle. A chunk of one owner names that owner in its aggregate; what
    remains of a group's distinct bytes is shared. So no copy is ever joined
    back to its hash.
    """
    # The filter drops nothing; it keeps the count in both uses below, so that
    # they are the same to Spark and the chunks are made and shuffled once.
    per_group = (
        chunks.groupBy("strong", group)
        .agg(F.count("*").alias("n"), F.min("len").alias("len"))
        .filter("n > 0")
    )
    totals = per_group.groupBy(group).agg(
        F.sum("n").alias("chunks"),
        F.count("*").alias("unique_chunks"),
        F.sum(F.col("n") * F.col("len")).alias("bytes"),
        F.sum("len").alias("_unique"),
    )
    own = (
        per_group.groupBy("strong")
        .agg(F.count("*").alias("owners"), F.min(group).alias(group), F.min("len").alias("len"))
        .filter("owners = 1")
        .groupBy(group)
        .agg(F.sum("len").alias("_own"))
    )
    return totals.join(own, group, "left").select(
        group,
        "chunks",
        "unique_chunks",
        "bytes",
        (F.col("bytes") - F.col("_unique")).alias("duplicate_bytes"),
        (F.col("_unique") - F.coalesce("_own", F.lit(0))).alias("shared_bytes"),
        F.round(F.col("_unique") / F.col("bytes"), 6).alias("dedup_ratio"),
    )
