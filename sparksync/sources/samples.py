"""Example inventories derived from the shared tables; queries, tests and the bench use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sparksync.functions.content import strong_hash
from sparksync.functions.paths import ancestors
from sparksync.session import checkpointed


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table; its schema is read from the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table as a file stream; the glob lets it be one file or a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _doc_path() -> Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id"), F.lit(".txt")))


def _mode() -> Column:
    return F.when(F.col("doc_id") % 8 == 0, 493).when(F.col("doc_id") % 8 == 1, 2541).otherwise(420)


def src_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as the current source tree."""
    doc = F.col("doc_id")
    data = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        _doc_path().alias("path"),
        F.lit("file").alias("kind"),
        F.octet_length(data).cast("bigint").alias("size"),
        _mode().cast("int").alias("mode"),
        (doc * 60 + 1700000000).alias("mtime_sec"),
        (doc % 1000).cast("int").alias("mtime_nsec"),
        strong_hash(data).alias("hash"),
        F.col("text").alias("content"),
    )


def dst_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older snapshot of the documents with one kind of drift per ``doc_id % 10``."""
    doc = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    last = doc % 10
    content = (
        F.when(last == 1, F.concat(F.substring("text", 1, 100), F.lit("EDIT"), F.expr("substring(text, 101)")))
        .when(last == 6, F.concat(F.expr("substring(text, 2)"), F.substring("text", 1, 1)))
        .otherwise(F.col("text"))
    )
    kept = docs.filter(last != 0).select(
        "doc_id",
        _doc_path().alias("path"),
        content.alias("content"),
        F.when(last == 5, 384).otherwise(_mode()).cast("int").alias("mode"),
        (doc * 60 + 1700000000 + F.when(last == 2, -1).when(last == 3, 3600).otherwise(0)).alias("mtime_sec"),
        (doc % 1000 + F.when(last == 4, 1).otherwise(0)).cast("int").alias("mtime_nsec"),
    )
    stale = docs.filter(doc % 25 == 0).select(
        "doc_id",
        F.concat_ws("/", F.lit("stale"), "lang", F.concat(F.col("doc_id"), F.lit(".txt"))).alias("path"),
        F.col("text").alias("content"),
        F.lit(420).alias("mode"),
        F.lit(1600000000).cast("bigint").alias("mtime_sec"),
        F.lit(0).alias("mtime_nsec"),
    )
    data = F.col("content").cast("binary")
    return kept.unionByName(stale).select(
        "doc_id",
        "path",
        F.lit("file").alias("kind"),
        F.octet_length(data).cast("bigint").alias("size"),
        "mode",
        "mtime_sec",
        "mtime_nsec",
        strong_hash(data).alias("hash"),
        "content",
    )


def swapped(src: DataFrame, dst: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with more rows: every fiftieth document also takes the place of a directory, and empties a file."""
    some = src.filter("doc_id % 50 = 3")
    named = lambda df, path, kind="file": df.withColumn("path", path).withColumn("kind", F.lit(kind))
    swap, emptied = (F.concat(F.lit(f"{top}/"), F.col("doc_id").cast("string")) for top in ("swap", "emptied"))
    nothing = F.lit("")
    empty = some.withColumn("size", F.lit(0).cast("bigint")).withColumn("content", nothing).withColumn("hash", strong_hash(nothing.cast("binary")))
    folder = empty.withColumn("hash", F.lit(None).cast("string"))
    more_src = named(some, swap).unionByName(named(empty, emptied))
    more_dst = named(folder, swap, "dir").unionByName(named(some, F.concat(swap, F.lit("/x")))).unionByName(named(some, emptied))
    return src.unionByName(more_src), dst.unionByName(more_dst)


def with_content_inode(manifest: DataFrame) -> DataFrame:
    """Rows with equal content share a group, named by the whole hash."""
    return manifest.withColumn("inode", F.col("hash"))


def link_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as symbolic links: siblings in rings of four, cousins, outside, self, above the root."""
    page = F.col("page_id")
    ring = F.floor(page / 80) * 80 + (page + 20) % 80
    target = (
        F.when(page % 5 == 0, F.concat(F.lit("p"), ring.cast("string")))
        .when(
            page % 5 == 1,
            F.concat(F.lit("../site"), ((page + 1) % 20).cast("string"), F.lit("/p"), (page + 1).cast("string")),
        )
        .when(page % 5 == 2, F.concat(F.lit("/ext/"), page.cast("string")))
        .when(page % 5 == 3, F.concat(F.lit("./p"), page.cast("string")))
        .otherwise(F.lit("../../outside"))
    )
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("site"), (page % 20).cast("string"), F.lit("/p"), page.cast("string")).alias("path"),
        F.lit("symlink").alias("kind"),
        target.alias("link_target"),
    )


def link_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page links with files, chains of up to thirty links, targets behind links, and directories in a ring."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("p"), F.expr("page_id div 50").alias("b"), F.expr("page_id div 30").alias("c"))

    def rows(condition: str, path: str, target: str) -> DataFrame:
        return pages.filter(condition).selectExpr(f"{path} AS path", f"CAST({target} AS STRING) AS link_target")

    box = "concat('data/b', b)"
    head = f"""CASE c % 4 WHEN 0 THEN concat('../', {box}, '/f', p) WHEN 1 THEN concat('/ext/', p + 7)
        WHEN 2 THEN concat('../', {box}) ELSE concat('../data/none', p) END"""
    files = rows("p % 3 = 0", f"concat({box}, '/f', p)", "NULL")
    chains = rows("true", "concat('chain/c', p)", f"CASE WHEN p % 30 = 0 THEN {head} ELSE concat('c', p - 1) END")
    behind = rows("p % 3 = 0", "concat('via/v', p)", "concat('../chain/c', c * 30, '/f', p)")
    hubs = rows("p % 10 = 0", "concat('hub', b, '/h', p)", f"CASE WHEN p % 20 = 0 THEN concat('../', {box}) ELSE concat('../back', b) END")
    back = rows("p % 50 = 0", "concat('back', b, '/up')", "concat('../hub', b)")
    more = files.unionByName(chains).unionByName(behind).unionByName(hubs).unionByName(back)
    pages_as_links = link_inventory(spark, sf_dir).select("path", "link_target")
    kind = F.when(F.col("link_target").isNull(), "file").otherwise("symlink")
    return pages_as_links.unionByName(more).select("path", kind.alias("kind"), "link_target")


def tree_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the old snapshot, their directories, and the page links."""
    files = dst_manifest(spark, sf_dir).select(
        "path", "kind", "size", F.lit(None).cast("string").alias("link_target")
    )
    dirs = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().select(
        "path", F.lit("dir").alias("kind"), F.lit(0).cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("link_target"),
    )
    links = link_inventory(spark, sf_dir).select(
        "path", "kind", F.lit(0).cast("bigint").alias("size"), "link_target"
    )
    return files.unionByName(dirs).unionByName(links)


def delta_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Changed documents: source and basis content of paths whose hashes differ.

    One join makes both sides; what differs is written once.
    """
    basis = dst_manifest(spark, sf_dir).select("path", F.col("hash").alias("old_hash"), F.col("content").alias("old_content"))
    pair = src_manifest(spark, sf_dir).select("path", "hash", "content").join(basis, "path").filter("hash <> old_hash")
    pair = checkpointed(pair)
    return pair.select("path", "hash", "content"), pair.select("path", F.col("old_hash").alias("hash"), F.col("old_content").alias("content"))


def with_emptied(source: DataFrame, basis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A pair with more rows: every tenth changed path has a neighbour that lost all its bytes."""
    some = source.filter(F.substring("hash", 1, 1).isin("0", "8"))
    named = some.withColumn("path", F.concat(F.lit("emptied/"), "path"))
    nothing = named.withColumn("content", F.lit("")).withColumn("hash", strong_hash(F.lit("").cast("binary")))
    return source.unionByName(nothing), basis.unionByName(named)


def external_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exists outside the synced root, by absolute path."""
    page = F.col("page_id")
    return table(spark, sf_dir, "pages").filter((page % 5 == 2) & (page % 3 != 0)).select(
        F.concat(F.lit("/ext/"), page.cast("string")).alias("path"),
        F.when(page % 3 == 1, "file").otherwise("dir").alias("kind"),
    )


def external_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exists outside, with a file and a link back in each directory."""
    known = external_paths(spark, sf_dir).withColumn("link_target", F.lit(None).cast("string"))
    dirs = known.filter("kind = 'dir'")
    inner = dirs.select(F.concat("path", F.lit("/x")).alias("path"), F.lit("file").alias("kind"), "link_target")
    again = dirs.select(F.concat("path", F.lit("/again")).alias("path"), F.lit("symlink").alias("kind"), F.col("path").alias("link_target"))
    return known.unionByName(inner).unionByName(again)


def as_instant(wall_clock: Column) -> Column:
    """A stored UTC wall clock as an instant, whatever the session's time zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall_clock).cast("timestamp")


def as_wall_clock(instant: Column) -> Column:
    """The reverse of ``as_instant``."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with an instant-typed timestamp, as watermarks need it."""
    return table(spark, sf_dir, "events").withColumn("ts", as_instant(F.col("ts")))


def progress_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as progress reports: bytes done so far per order within each user's clock."""
    ev = events(spark, sf_dir)
    done = F.col("event_id") * 100 + (F.col("value") * 100).cast("bigint")
    return ev.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("path"),
        "ts",
        "event_id",
        done.alias("done"),
        F.lit(500_000).cast("bigint").alias("total"),
    )
