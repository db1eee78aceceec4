"""Filters on entries and on change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparksync.functions import globs, paths


def glob_filter(entries: DataFrame, includes: list[str] = (), excludes: list[str] = ()) -> DataFrame:
    """Entries that pass the patterns, each path on its own."""
    return entries.filter(globs.passes(F.col("path"), includes, excludes))


def tree_filter(entries: DataFrame, includes: list[str] = (), excludes: list[str] = ()) -> DataFrame:
    """As ``glob_filter``, but an excluded directory hides everything below it."""
    visible = lambda p: globs.passes(p, includes, excludes)
    return entries.filter(
        visible(F.col("path")) & F.forall(paths.ancestors(F.col("path")), visible)
    )


def mark_unsafe_paths(entries: DataFrame) -> DataFrame:
    """Add ``unsafe``: why a path may not be used below a root, null if it may."""
    path = paths.wire_path(F.col("path"))
    reason = (
        F.when(path == "", "empty")
        .when(path.startswith("/"), "absolute")
        .when(path.rlike(r"\A[A-Za-z]:"), "absolute")
        .when(path.rlike(r"(?s)(?:\A|/)\.\.(?:/|\z)"), "traversal")
    )
    return entries.withColumn("unsafe", reason)


def quarantine_unsafe_paths(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into usable entries and quarantined ones with the reason."""
    marked = mark_unsafe_paths(entries)
    return (
        marked.filter(F.col("unsafe").isNull()).drop("unsafe"),
        marked.filter(F.col("unsafe").isNotNull()),
    )


def syncworthy_events(events: DataFrame, read_only: list[str] = ("access",)) -> DataFrame:
    """Drop pure reads from a change feed; works on batch and streaming frames."""
    return events.filter(~F.col("event_type").isin(*read_only))
