"""The delete set: scope, protection, guard, order, emptied directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparksync.functions import globs, paths
from sparksync.sources.roots import entries_under, topmost_roots


class DeleteLimitExceeded(ValueError):
    """The plan deletes more entries than allowed."""


def plan_delete(src: DataFrame, dst: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Destination entries the source does not name, within ``scope`` roots if given."""
    extra = dst.select("path", "kind").join(src.select("path"), "path", "left_anti")
    return extra if scope is None else delete_scope_filter(extra, scope)


def delete_scope_filter(entries: DataFrame, scope: DataFrame) -> DataFrame:
    """Entries equal to a scope root or below one at a component boundary."""
    roots = scope.select(paths.wire_path(F.col("root")).alias("root"))
    return entries_under(entries, topmost_roots(roots))


def protect_from_delete(
    deletes: DataFrame,
    skipped: DataFrame,
    includes: list[str] = (),
    excludes: list[str] = (),
    protect_subtrees: bool = False,
) -> DataFrame:
    """Drop deletes the filter hides, and those at or below a policy-skipped source path.

    The filter looks at the path alone; ``protect_subtrees`` also keeps
    everything below a hidden directory.
    """
    keep = globs.passes(F.col("path"), includes, excludes)
    if protect_subtrees:
        visible = lambda d: globs.passes(d, includes, excludes)
        keep = keep & F.forall(paths.ancestors(F.col("path")), visible)
    open_deletes = deletes.filter(keep)
    tops = topmost_roots(skipped.select(F.col("path").alias("root")))
    shielded = entries_under(open_deletes.select("path"), tops)
    return open_deletes.join(shielded, "path", "left_anti")


def delete_guard(deletes: DataFrame, limit: int) -> DataFrame:
    """One row: how many deletes there are and whether the limit allows them."""
    return deletes.agg(F.count("*").alias("n_deletes")).withColumn(
        "allowed", F.col("n_deletes") <= limit
    )


def max_delete_guard(deletes: DataFrame, limit: int) -> None:
    """Refuse a delete set above ``limit`` before anything is written."""
    refuse_above(delete_guard(deletes, limit).first()["n_deletes"], limit)


def refuse_above(n_deletes: int, limit: int) -> None:
    if n_deletes > limit:
        raise DeleteLimitExceeded(f"refusing to delete {n_deletes} entries: limit is {limit}")


def delete_order(deletes: DataFrame) -> DataFrame:
    """Sort files first, then directories children before parents.

    ``phase`` and ``depth`` are the parts of the order that matter: everything
    of one (phase, depth) may go at the same time. No global numbering is
    computed, that would need one task.
    """
    is_dir = F.col("kind") == "dir"
    ordered = deletes.withColumn("phase", F.when(is_dir, 1).otherwise(0)).withColumn(
        "depth", F.when(is_dir, F.size(F.split("path", "/"))).otherwise(0)
    )
    return ordered.orderBy("phase", F.when(is_dir, F.col("path")).desc_nulls_first(), "path")


def prune_empty_dirs(dst: DataFrame, deletes: DataFrame) -> DataFrame:
    """Directories that lose their last entry when the deleted files go.

    Pruning climbs from deleted files only, and stops at the first directory
    that still holds something; the directory itself does not count.
    """
    gone_files = deletes.filter(F.col("kind") != "dir")
    touched = gone_files.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    left = dst.select("path", "kind").join(gone_files.select("path"), "path", "left_anti")
    # A directory not on the way to a deleted file is still there while files
    # go, so it occupies its parents like a file does.
    idle = left.filter(F.col("kind") == "dir").join(touched, "path", "left_anti")
    files = left.filter(F.col("kind") != "dir")
    occupied = (
        files.select("path").union(idle.select("path"))
        .select(F.explode(paths.ancestors(F.col("path"))).alias("path"))
        .distinct()
    )
    return touched.join(occupied, "path", "left_anti")
