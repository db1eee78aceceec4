"""Reuse stored signatures of blobs that did not change."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparksync.functions.content import strong_hash

CACHE_KEY = ["path", "size", "mtime_sec", "mtime_nsec", "hash", "engine"]


def cache_heads(blobs: DataFrame, engine: str, content: str = "content") -> DataFrame:
    """What must agree for a stored signature to be served: size, times, the hash of the whole content, engine."""
    known = F.col("hash") if "hash" in blobs.columns else strong_hash(F.col(content).cast("binary"))
    return blobs.select(
        "path", "size", "mtime_sec", "mtime_nsec", known.alias("hash"),
        F.lit(engine).alias("engine"),
    )


def signature_cache_entries(blobs: DataFrame, signature: DataFrame, engine: str, content: str = "content") -> DataFrame:
    """Signature rows with their cache key, ready to be written as a table."""
    return cache_heads(blobs, engine, content).join(signature, "path")


def signature_cache(
    blobs: DataFrame, cache: DataFrame, engine: str, content: str = "content"
) -> tuple[DataFrame, DataFrame]:
    """Cached signature rows that are still valid, and the blobs that must be signed again.

    A stale or foreign entry is simply a miss.
    """
    heads = cache_heads(blobs, engine, content)
    hits = cache.join(heads, CACHE_KEY, "left_semi")
    # One key per blob, not one per chunk.
    misses = heads.join(cache.select(*CACHE_KEY).distinct(), CACHE_KEY, "left_anti").select("path")
    return hits, misses
