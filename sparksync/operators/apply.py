"""Applying a plan: a new destination snapshot, backups, retirement, resume, publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparksync.functions import paths
from sparksync.plans.planner import replaced_directories

ATTRIBUTES = ("mode", "mtime_sec", "mtime_nsec")


def apply_plan(plan: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """The destination after the plan: kept rows, source rows for creates and updates, no deletes.

    Metadata fixes change attributes only. What has to go below a replaced
    directory is in the plan. Each side's content is shuffled at
    most once, and not at all when the changed part of the plan is small
    enough for the adaptive planner to broadcast it.
    """
    changed = plan.filter(F.col("action") != "skip").select("path", "action")
    attrs = src.select("path", *[F.col(c).alias(f"_new_{c}") for c in ATTRIBUTES])
    fixes = changed.filter(F.col("action") == "meta").join(attrs, "path")
    gone = changed.filter(F.col("action").isin("update", "delete"))
    marks = fixes.unionByName(gone, allowMissingColumns=True)
    kept = dst.join(marks, "path", "left").filter(
        F.col("action").isNull() | (F.col("action") == "meta")
    )
    for c in ATTRIBUTES:
        kept = kept.withColumn(c, F.coalesce(f"_new_{c}", c))
    kept = kept.select(*dst.columns)
    moved = src.join(
        changed.filter(F.col("action").isin("create", "update")).select("path"), "path", "left_semi"
    )
    return kept.unionByName(moved.select(*[c for c in dst.columns if c in src.columns]), allowMissingColumns=True)


def backup_replaced(plan: DataFrame, dst: DataFrame) -> DataFrame:
    """Prior versions of replaced and deleted files, at ``<path>~``.

    A directory that gives way to something else moves as a whole: what was at
    ``a/x`` is kept at ``a~/x``, since nothing can lie below ``a`` any more.
    """
    hit = plan.filter(F.col("action").isin("update", "delete") & (F.col("reason") != "replaced")).select("path")
    old = dst.filter(F.col("kind") != "dir").join(hit, "path", "left_semi").withColumn("path", F.concat("path", F.lit("~")))
    roots = replaced_directories(plan)
    moved = dst.join(roots, "path", "left_semi").withColumn("path", F.concat("path", F.lit("~")))
    cleared = plan.filter(F.col("reason") == "replaced").select("path", F.explode(paths.ancestors(F.col("path"))).alias("root"))
    cleared = cleared.join(roots.select(F.col("path").alias("root")), "root").groupBy("path").agg(F.min("root").alias("_root"))
    rest = F.substr(F.col("path"), F.length("_root") + 1)
    below = dst.join(cleared, "path").withColumn("path", F.concat("_root", F.lit("~"), rest)).select(*dst.columns)
    return old.unionByName(moved).unionByName(below)


def with_backups(snapshot: DataFrame, backups: DataFrame) -> DataFrame:
    """Add backups to a snapshot; an older backup at the same path goes (one generation)."""
    return snapshot.join(backups.select("path"), "path", "left_anti").unionByName(backups)


def retire_verified_sources(
    scanned: DataFrame, current: DataFrame, transferred: DataFrame, received: DataFrame, skipped: DataFrame
) -> DataFrame:
    """The source that stays after verified entries are removed.

    Removed are entries that were transferred, whose received hash is equal,
    that no side skipped, whose size and times are still as scanned, and
    whose content came from inside the root.
    """
    same = ["path", "size", "mtime_sec", "mtime_nsec"]
    stable = scanned.select(*same, "dereferenced").join(current.select(*same), same, "left_semi")
    own = stable.filter(~F.coalesce("dereferenced", F.lit(False))).select("path")
    verified = transferred.select("path", "hash").join(
        received.select("path", "hash"), ["path", "hash"], "left_semi"
    )
    removable = (
        verified.select("path")
        .join(own, "path", "left_semi")
        .join(skipped.select("path"), "path", "left_anti")
    )
    return current.join(removable, "path", "left_anti")


def resume_apply(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """What is left of a plan after an aborted run; ``ledger`` lists (path, action) already applied."""
    todo = plan.filter(F.col("action") != "skip")
    return todo.join(ledger.select("path", "action"), ["path", "action"], "left_anti")


def _fs(spark: SparkSession, location: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return path, path(location).getFileSystem(conf)


def write_whole(df: DataFrame, staged: str, final: str, compression: str = "snappy", buckets: int = 0) -> None:
    """Write to ``staged``, then show the folder at ``final`` by one rename.

    A failed write removes what it staged. A folder already at ``final``, from
    an earlier try of the same step, is replaced. With ``buckets`` rows lie in
    one folder per hash bucket of their path, so that a reader of few paths
    opens few folders.
    """
    path, fs = _fs(df.sparkSession, final)
    try:
        if buckets:
            df = df.withColumn(BUCKET, bucket_of(F.col("path"), buckets)).repartition(BUCKET)
            df.write.option("compression", compression).partitionBy(BUCKET).parquet(staged)
        else:
            df.write.option("compression", compression).parquet(staged)
        fs.mkdirs(path(final).getParent())
        if fs.exists(path(final)):
            fs.delete(path(final), True)
        if not fs.rename(path(staged), path(final)):
            raise OSError(f"could not move {staged} to {final}")
    except Exception:
        fs.delete(path(staged), True)
        raise


BUCKET = "_bucket"


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def buckets_of_run(run: str) -> int:
    """How many buckets a run was published with; its name tells."""
    return int(run.partition("-")[2] or 0)


def publish_snapshot(df: DataFrame, location: str, compression: str = "snappy", buckets: int = 0) -> str:
    """Write a snapshot so that readers see the old one or the new one, never a half.

    Data goes to a staging folder, moves to its final folder by one rename,
    and becomes current when the small pointer file names it. A failed run
    leaves no trace and the pointer alone.
    """
    run = uuid.uuid4().hex + (f"-{buckets}" if buckets else "")
    write_whole(df, f"{location}/_staging/{run}", f"{location}/snapshots/{run}", compression, buckets)
    _point_to(df.sparkSession, location, run)
    return run


def expire_runs(spark: SparkSession, location: str, keep: int = 2) -> list[str]:
    """Delete the data of all but the ``keep`` newest runs; the current one always stays."""
    path, fs = _fs(spark, location)
    current = current_run(spark, location)
    found = sorted(fs.listStatus(path(f"{location}/snapshots")), key=lambda s: -s.getModificationTime())
    old = [s.getPath().getName() for s in found[keep:] if s.getPath().getName() != current]
    for run in old:
        for folder in ("snapshots", "changes"):
            fs.delete(path(f"{location}/{folder}/{run}"), True)
    return old


def _point_to(spark: SparkSession, location: str, run: str) -> None:
    """Replace the pointer file by an atomic overwriting rename."""
    jvm = spark.sparkContext._jvm
    path, fs = _fs(spark, location)
    fresh = path(f"{location}/_staging/{run}.pointer")
    out = fs.create(fresh, True)
    out.write(bytearray(run.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.makeQualified(fresh).toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    rename = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename
    context.rename(fs.makeQualified(fresh), fs.makeQualified(path(f"{location}/CURRENT")), options)


def current_run(spark: SparkSession, location: str) -> str | None:
    """The run the pointer names, or None before the first publish."""
    path, fs = _fs(spark, location)
    pointer = path(f"{location}/CURRENT")
    if not fs.exists(pointer):
        return None
    return spark.read.text(pointer.toString()).first()["value"]


def read_snapshot(spark: SparkSession, location: str) -> DataFrame:
    run = current_run(spark, location)
    if run is None:
        raise FileNotFoundError(f"no snapshot published at {location}")
    return spark.read.parquet(f"{location}/snapshots/{run}").drop(BUCKET)


def read_buckets(spark: SparkSession, location: str, run: str, wanted: list[int]) -> DataFrame:
    """The rows of a bucketed snapshot in some of its buckets; other folders are not opened."""
    return spark.read.parquet(f"{location}/snapshots/{run}").filter(F.col(BUCKET).isin(wanted)).drop(BUCKET)
