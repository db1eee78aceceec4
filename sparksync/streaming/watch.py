"""Incremental sync on Structured Streaming: one plan and apply per micro-batch of changes."""

from __future__ import annotations

import hashlib
import itertools
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from sparksync.operators.apply import (
    BUCKET,
    apply_plan,
    bucket_of,
    buckets_of_run,
    current_run,
    publish_snapshot,
    read_buckets,
    read_snapshot,
    write_whole,
)
from sparksync.plans.planner import below_replaced, plan_sync, replaced_directories
from sparksync.session import checkpointed

RETRY_SECONDS = 5.0
# Seconds per duration unit.
_UNITS = {"d": 86_400, "h": 3_600, "m": 60, "s": 1}


def parse_duration(text: str) -> int:
    """Seconds of ``1h30m``, ``45s``, ``1d 2h`` or a plain number; zero is an error."""
    compact = text.strip().lower().replace(" ", "")
    if not re.fullmatch(r"(?:\d+[dhms])*\d*", compact) or not compact:
        raise ValueError(f"invalid duration '{text}'")
    total = sum(int(n) * _UNITS[u or "s"] for n, u in re.findall(r"(\d+)([dhms]?)", compact))
    if total == 0:
        raise ValueError(f"duration '{text}' is zero")
    return total


def sync_cycle(source: DataFrame, location: str, buckets: int = 0, **flags) -> None:
    """One full plan and apply against the state at ``location``."""
    spark = source.sparkSession
    if current_run(spark, location) is None:
        publish_snapshot(source, location, buckets=buckets)
        return
    dst = read_synced(spark, location)
    publish_snapshot(apply_plan(plan_sync(source, dst, **flags), source, dst), location, buckets=buckets)


def latest_changes(changes: DataFrame) -> DataFrame:
    """The newest change per path of a burst, by one combined maximum."""
    cols = [c for c in changes.columns if c != "path"]
    newest = F.max_by(F.struct(*cols), F.struct("seq")).alias("_row")
    return changes.groupBy("path").agg(newest).select("path", "_row.*")


def _changes_folder(spark: SparkSession, location: str, run: str) -> tuple[str, list[str]]:
    """Where changes on top of a snapshot are, and the names of the folders there."""
    folder = f"{location}/changes/{run}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(folder)):
        return folder, []
    found = fs.globStatus(path(f"{folder}/turn=*/tag=*"))
    return folder, [f"{s.getPath().getParent().getName()}/{s.getPath().getName()}" for s in found]


def _change_log(spark: SparkSession, location: str, run: str) -> DataFrame | None:
    """All versions written on top of a snapshot with their ``turn`` and ``tag``, or None."""
    folder, written = _changes_folder(spark, location, run)
    if not written:
        return None
    # The columns are known, so no file is opened to find them, and a burst that changed nothing may have no file.
    more = [("deleted", T.BooleanType()), ("action", T.StringType()), ("turn", T.LongType()), ("tag", T.StringType()), (BUCKET, T.IntegerType())]
    columns = read_snapshot(spark, location).schema.fields + [T.StructField(c, t) for c, t in more]
    return spark.read.schema(T.StructType(columns)).option("basePath", folder).parquet(*[f"{folder}/{name}" for name in written])


def read_synced(spark: SparkSession, location: str, touching: DataFrame | None = None) -> DataFrame:
    """The current state: the published snapshot with the changes written since.

    ``touching`` has the paths that will be looked at. Where the snapshot is
    bucketed only their buckets are read, of the snapshot and of the changes.
    """
    run = current_run(spark, location)
    base, log = read_snapshot(spark, location), _change_log(spark, location, run)
    buckets = buckets_of_run(run)
    if touching is not None and buckets:
        # At most as many numbers as there are buckets.
        wanted = [r.b for r in touching.select(bucket_of(F.col("path"), buckets).alias("b")).distinct().collect()]
        base = read_buckets(spark, location, run, wanted)
        log = log if log is None else log.filter(F.col(BUCKET).isin(wanted))
    if log is None:
        return base
    # Each column by itself, so that a reader who wants no content shuffles none; equal turns pick one row for all.
    newest = [F.max_by(c, "turn").alias(c) for c in base.columns if c != "path"]
    latest = log.groupBy("path").agg(F.max_by("deleted", "turn").alias("_deleted"), *newest)
    alive = latest.filter(~F.col("_deleted")).select(*base.columns)
    return base.join(log.select("path"), "path", "left_anti").unionByName(alive)


def applied_ledger(spark: SparkSession, location: str, tag: str) -> DataFrame:
    """(path, action) of what a run has written under tags that begin with ``tag``; data and ledger are one write."""
    log = _change_log(spark, location, current_run(spark, location))
    if log is None:
        return spark.createDataFrame([], "path string, action string")
    return log.filter(F.col("tag").startswith(tag) & F.col("action").isNotNull()).select("path", "action")


def compact(spark: SparkSession, location: str) -> None:
    """Publish the current state as a new snapshot without pending changes, in as many buckets as before."""
    publish_snapshot(read_synced(spark, location), location, buckets=buckets_of_run(current_run(spark, location)))


def _is_applied(spark: SparkSession, location: str, tag: str) -> bool:
    _, written = _changes_folder(spark, location, current_run(spark, location))
    return any(name.endswith(f"/tag={tag}") for name in written)


def append_versions(rows: DataFrame, location: str, tag: str, compression: str = "snappy") -> int:
    """Write the new versions of changed rows on top of the current snapshot; returns their turn.

    ``rows`` has the columns of the snapshot and ``deleted``; only they are
    written, and they show as a whole or not at all.
    """
    spark = rows.sparkSession
    folder, written = _changes_folder(spark, location, current_run(spark, location))
    turn = 1 + max((int(name.split("/")[0].removeprefix("turn=")) for name in written), default=0)
    buckets = buckets_of_run(current_run(spark, location))
    write_whole(rows, f"{location}/_staging/{uuid.uuid4().hex}", f"{folder}/turn={turn}/tag={tag}", compression, buckets)
    return turn


def apply_changes(changes: DataFrame, location: str, tag: str) -> None:
    """Fold one burst in: its paths are planned against the current state, others are not touched.

    ``changes`` has manifest columns plus ``seq`` and ``deleted``. Only the new
    versions of changed rows are written, in a folder of their own, so the
    cost follows the burst and not the table. ``tag`` names the burst; one
    that is already written is not applied again.
    """
    spark = changes.sparkSession
    burst = latest_changes(changes).persist()
    try:
        alive = burst.filter(~F.col("deleted")).drop("seq", "deleted")
        run = current_run(spark, location)
        if run is None:
            publish_snapshot(alive, location)
            return
        if _is_applied(spark, location, tag):
            return
        touched = read_synced(spark, location, touching=alive).join(alive.select("path"), "path", "left_semi")
        plan = checkpointed(plan_sync(alive, touched).filter("action <> 'skip'"))
        fixed = plan.filter("action = 'meta'").select("path")
        versions = apply_plan(plan, alive, touched.join(fixed, "path", "left_semi"))
        gone = burst.filter("deleted").select("path", F.lit(True).alias("deleted"))
        replaced = replaced_directories(plan)
        if not replaced.isEmpty():
            # The whole state is looked at only when a directory gives way to something else.
            cleared = below_replaced(alive, read_synced(spark, location), replaced).join(gone.select("path"), "path", "left_anti")
            gone = gone.unionByName(cleared.select("path", F.lit(True).alias("deleted")))
        rows = versions.withColumn("deleted", F.lit(False)).unionByName(gone, allowMissingColumns=True)
        append_versions(rows, location, tag)
    finally:
        burst.unpersist()


def retry_cycle(step: Callable[[], None], attempts: int | None = None, backoff: float = RETRY_SECONDS) -> None:
    """Run a cycle; when it fails, run it again with the same input after a pause, for ever or ``attempts`` times."""
    for attempt in itertools.count(1):
        try:
            return step()
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(backoff)


def watch_sync(
    changes: DataFrame,
    location: str,
    checkpoint: str,
    baseline: DataFrame | None = None,
    attempts: int | None = None,
    backoff: float = RETRY_SECONDS,
    available_now: bool = False,
    processing_time: str = "5 seconds",
    compact_every: int = 100,
    buckets: int = 0,
    apply: Callable[[DataFrame, str, str], None] = apply_changes,
) -> StreamingQuery:
    """Baseline sync if nothing is published yet, then one plan and apply per micro-batch; ``read_synced`` shows the state.

    Changes that arrive during a cycle form the next micro-batch, so they
    fold into one more cycle. A failed cycle is retried with the same batch;
    folding a batch in twice gives the same state, so a replay after a
    restart from ``checkpoint`` is safe. With ``buckets`` the baseline lies in
    so many hash buckets, and a batch reads only those of its paths.
    """
    # A snapshot that is there already holds what earlier cycles applied, which the checkpoint does not replay.
    if baseline is not None and current_run(changes.sparkSession, location) is None:
        sync_cycle(baseline, location, buckets)

    # Batch numbers are only unique within one checkpoint.
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def cycle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        retry_cycle(lambda: apply(batch, location, f"{stream}-{batch_id}"), attempts, backoff)
        if batch_id % compact_every == compact_every - 1:
            compact(batch.sparkSession, location)

    writer = changes.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": processing_time}
    return writer.trigger(**trigger).start()


def bounded_watch(query: StreamingQuery, duration: str, idle: str | None = None) -> bool:
    """Let a watch run for ``duration``, or until nothing came for ``idle``, then stop it; True if it ended by itself."""
    deadline = time.monotonic() + parse_duration(duration)
    patience = None if idle is None else parse_duration(idle)
    quiet_since = None
    while time.monotonic() < deadline:
        if query.awaitTermination(min(0.5, max(deadline - time.monotonic(), 0.001))):
            return True
        status, now = query.status, time.monotonic()
        busy = status["isTriggerActive"] or status["isDataAvailable"] or query.lastProgress is None
        quiet_since = None if busy else (quiet_since or now)
        if patience is not None and quiet_since is not None and now - quiet_since >= patience:
            break
    query.stop()
    return False


def watch_totals(cycles: DataFrame) -> DataFrame:
    """Running files and bytes over all cycles; a streaming frame needs update or complete mode."""
    return cycles.groupBy("action").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("bytes")
    )


def keep_totals(cycles: DataFrame, location: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the totals of a stream of cycles: each batch writes the actions whose totals it changed, and no others."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # A batch that runs again replaces what it wrote.
        batch.write.mode("overwrite").parquet(f"{location}/batch={batch_id}")

    writer = watch_totals(cycles).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": "5 seconds"})).start()


def read_totals(spark: SparkSession, location: str) -> DataFrame:
    """The latest total of every action."""
    rows = spark.read.parquet(location)
    latest = rows.groupBy("action").agg(F.max_by(F.struct("files", "bytes"), "batch").alias("t"))
    return latest.select("action", "t.files", "t.bytes")
