"""Inventories of file trees and keyed tables."""

from __future__ import annotations

import os.path
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparksync.functions import globs, paths
from sparksync.functions.content import strong_hash
from sparksync.session import checkpointed
from sparksync.sources.listing import ENTRY_SCHEMA, can_list, directory_lister, file_hasher

KINDS = ("file", "dir", "symlink", "fifo", "socket", "block", "char")

# Columns a planner may read, with the type used where an inventory lacks one.
MANIFEST_COLUMNS = {
    "path": "string",
    "kind": "string",
    "size": "bigint",
    "mode": "int",
    "mtime_sec": "bigint",
    "mtime_nsec": "int",
    "hash": "string",
    "link_target": "string",
    "inode": "bigint",
    "rdev": "bigint",
    "dereferenced": "boolean",
}


def with_manifest_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Select ``names``, filling the ones ``df`` lacks (kind: file, others: null)."""
    have = set(df.columns)
    return df.select(
        *[
            F.col(n) if n in have
            else F.lit("file" if n == "kind" else None).cast(MANIFEST_COLUMNS[n]).alias(n)
            for n in names
        ]
    )


def scan_manifest(
    spark: SparkSession,
    root: str,
    recursive: bool = True,
    includes: list[str] = (),
    excludes: list[str] = (),
) -> DataFrame:
    """All entries below ``root`` with size, mode and times; no content is read.

    Directories are listed by the executors, one job per level of the tree,
    and a directory the patterns exclude is never entered. ``root`` must be
    reachable from every executor. A store only Spark can list is left to
    ``indexed_manifest``.
    """
    if not can_list(root):
        return indexed_manifest(spark, root, recursive, includes, excludes)
    keep = globs.passes(F.col("path"), includes, excludes)
    level = spark.createDataFrame([("",)], "path string")
    levels = []
    while True:
        # Listing is slow and uneven, so directories are dealt out anew.
        listed = level.repartition(spark.sparkContext.defaultParallelism).mapInPandas(
            directory_lister(root), ENTRY_SCHEMA
        )
        entries = checkpointed(listed.filter(keep))
        levels.append(entries)
        level = entries.filter("kind = 'dir'").select("path")
        if not recursive or level.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def hash_manifest(
    spark: SparkSession,
    root: str,
    recursive: bool = True,
    includes: list[str] = (),
    excludes: list[str] = (),
) -> DataFrame:
    """``scan_manifest`` plus a content hash of regular files, read as streams of any length."""
    if not can_list(root):
        return indexed_manifest(spark, root, recursive, includes, excludes, hashed=True)
    entries = scan_manifest(spark, root, recursive, includes, excludes)
    dealt = entries.repartition(spark.sparkContext.defaultParallelism * 4)
    return dealt.mapInPandas(file_hasher(root), ENTRY_SCHEMA + ", hash string")


def indexed_manifest(
    spark: SparkSession,
    root: str,
    recursive: bool = True,
    includes: list[str] = (),
    excludes: list[str] = (),
    hashed: bool = False,
) -> DataFrame:
    """Regular files below ``root`` as Spark's own file index sees them.

    The index works on every store Spark reads, but hides names that start
    with a dot or underscore, follows links, leaves out empty files, and gives
    milliseconds.
    Without ``hashed`` no content is read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
    )
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    prefix = base.getFileSystem(conf).makeQualified(base).toString().rstrip("/") + "/"
    # A local path is spelt 'file:/' or 'file:///' in different places.
    one_slash = lambda p: F.regexp_replace(p, r"\Afile:/+", "file:/")
    rel = F.substring(one_slash(F.col("path")), F.char_length(one_slash(F.lit(prefix))) + 1, F.char_length("path"))
    visible = F.forall(
        paths.ancestors(F.col("path"), include_self=True), lambda p: globs.passes(p, includes, excludes)
    )
    micros = F.unix_micros("modificationTime")
    rows = files.select(
        rel.alias("path"),
        F.lit("file").alias("kind"),
        F.col("length").alias("size"),
        F.floor(micros / 1_000_000).cast("bigint").alias("mtime_sec"),
        (F.pmod(micros, F.lit(1_000_000)) * 1000).cast("int").alias("mtime_nsec"),
        *([strong_hash(F.col("content")).alias("hash")] if hashed else []),
    )
    return rows.filter(visible) if includes or excludes else rows


def hash_table_manifest(manifest: DataFrame, content: str = "content") -> DataFrame:
    """Add the content hash to an inventory table; only regular files are hashed."""
    data = F.col(content).cast("binary")
    return manifest.withColumn("hash", F.when(F.col("kind") == "file", strong_hash(data)))


def table_manifest(
    df: DataFrame,
    path: Column,
    content: Column,
    mtime_sec: Column,
    mtime_nsec: Column | None = None,
    mode: Column | None = None,
    keep: list[str] = (),
) -> DataFrame:
    """Each row of a table becomes a manifest entry keyed by ``path``."""
    data = content.cast("binary")
    return df.select(
        path.alias("path"),
        F.lit("file").alias("kind"),
        F.octet_length(data).cast("bigint").alias("size"),
        (F.lit(0o644) if mode is None else mode).cast("int").alias("mode"),
        mtime_sec.cast("bigint").alias("mtime_sec"),
        (F.lit(0) if mtime_nsec is None else mtime_nsec).cast("int").alias("mtime_nsec"),
        strong_hash(data).alias("hash"),
        *keep,
    )


def probe_destination(dst: DataFrame, src: DataFrame) -> DataFrame:
    """Destination entries at paths the source names."""
    return dst.join(src.select("path"), "path", "left_semi")


def includes_root(source: str) -> bool:
    """Whether a source argument recreates its last component at the destination."""
    if source.endswith(("/", "\\")):
        return False
    return source.replace("\\", "/").rsplit("/", 1)[-1] not in ("", ".", "..")


def rebase_paths(manifest: DataFrame, source: str) -> DataFrame:
    """Apply the trailing-slash rule: ``dir`` prefixes entries with its name, ``dir/`` does not."""
    rel = paths.wire_path(F.col("path"))
    if includes_root(source):
        name = os.path.basename(source.replace("\\", "/"))
        rel = F.when(rel == "", name).otherwise(F.concat(F.lit(name + "/"), rel))
    return manifest.withColumn("path", rel)


def kind_letter(kind: Column, link_target: Column) -> Column:
    return (
        F.when(link_target.isNotNull() | (kind == "symlink"), "L")
        .when(kind == "dir", "d")
        .when(kind == "file", "f")
        .otherwise("S")
    )


def list_only(manifest: DataFrame, includes: list[str] = (), excludes: list[str] = ()) -> DataFrame:
    """What a transfer would consider: kind letter, size, path; specials list as plain entries."""
    m = with_manifest_columns(manifest, ["path", "kind", "size", "link_target"])
    letter = (
        F.when(F.col("kind") == "dir", "d")
        .when(F.col("link_target").isNotNull(), "L")
        .otherwise("f")
    )
    return m.filter(globs.passes(F.col("path"), includes, excludes)).select(
        letter.alias("kind"), "size", "path"
    )


def manifest_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("kind").agg(
        F.count("*").alias("entries"), F.sum("size").alias("total_bytes")
    )
