"""Counts, change lines, verification and rates of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparksync.functions.content import human_size
from sparksync.sources.manifest import kind_letter

PARTIAL_RUN_CODE = 23
TIE_SECONDS = 0.0005


def plan_counts(plan: DataFrame) -> DataFrame:
    """Entries and source bytes per action."""
    return plan.groupBy("action").agg(
        F.count("*").alias("entries"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("bytes")
    )


def change_line(action: Column, letter: Column) -> Column:
    """The 11-character change code; a metadata fix shows as an update."""
    return (
        F.when(action == "create", F.concat(F.lit("c"), letter, F.lit("+++++++++")))
        .when(action.isin("update", "meta"), F.concat(F.lit(">"), letter, F.lit(".s.......")))
        .when(action == "delete", F.lit("*deleting   "))
        .otherwise(F.concat(F.lit("."), letter, F.lit("..........")))
    )


def itemize(plan: DataFrame) -> DataFrame:
    """One change line per planned row."""
    target = F.col("link_target") if "link_target" in plan.columns else F.lit(None).cast("string")
    p = plan.withColumn("letter", kind_letter(F.col("kind"), target))
    line = F.concat_ws(" ", change_line(F.col("action"), F.col("letter")), "path")
    return p.select("path", line.alias("line"))


def sync_stats(plan: DataFrame, skipped: DataFrame) -> DataFrame:
    """Files and bytes transferred, files skipped; a metadata fix counts as a file of no bytes."""
    moved = F.col("action").isin("create", "update")
    totals = plan.agg(
        F.count(F.when(moved | (F.col("action") == "meta"), 1)).alias("files"),
        F.coalesce(F.sum(F.when(moved, F.col("source_size"))), F.lit(0)).alias("bytes"),
    )
    skips = skipped.agg(F.count("*").alias("n")).select("n")
    return totals.withColumn("skipped", skips.scalar())


def skip_report(skipped: DataFrame) -> DataFrame:
    """Skipped entries by reason; the exit code tells that the run was partial."""
    return skipped.groupBy("reason").agg(F.count("*").alias("entries")).withColumn(
        "exit_code", F.lit(PARTIAL_RUN_CODE)
    )


def verify_report(transferred: DataFrame, received: DataFrame, skipped: DataFrame) -> DataFrame:
    """ok / mismatch / no-hash / skipped per transferred path."""
    got = received.select("path", F.col("hash").alias("received_hash"))
    skip = skipped.select("path").distinct().withColumn("was_skipped", F.lit(True))
    status = (
        F.when(F.col("was_skipped"), "skipped")
        .when(F.col("received_hash").isNull() | F.col("hash").isNull(), "no-hash")
        .when(F.col("hash") != F.col("received_hash"), "mismatch")
        .otherwise("ok")
    )
    return (
        transferred.select("path", "hash")
        .join(got, "path", "left")
        .join(skip, "path", "left")
        .select("path", status.alias("status"))
    )


def progress_deltas(progress: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Bytes added by each report of a file: done minus the file's previous done.

    The previous report is looked up inside (path, time slice); only the first
    report of a slice needs the last one of the file's previous slice, and
    that comes from a table with one row per slice. So a file with most of
    the reports never becomes one window.
    """
    order = F.struct("ts", "event_id")
    sliced = progress.withColumn("_slice", F.floor(F.unix_timestamp("ts") / slice_seconds))
    ends = sliced.groupBy("path", "_slice").agg(F.max_by("done", order).alias("_last"))
    carried = ends.select(
        "path", "_slice", F.lag("_last").over(W.partitionBy("path").orderBy("_slice")).alias("_carried")
    )
    inside = W.partitionBy("path", "_slice").orderBy("ts", "event_id")
    first = F.row_number().over(inside) == 1
    prev = F.lag("done").over(inside)
    return (
        sliced.withColumn("_prev", prev).withColumn("_first", first)
        .join(carried, ["path", "_slice"])
        .withColumn("_prev", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_prev")))
        .withColumn("delta", F.greatest(F.col("done") - F.coalesce("_prev", F.lit(0)), F.lit(0)))
        .drop("_slice", "_prev", "_first", "_carried")
    )


def transfer_rate(progress: DataFrame, window_seconds: int = 86400) -> DataFrame:
    """Bytes, completed files and rate per time window.

    A file counts as completed once, at its first report with everything done.
    """
    start = F.floor(F.unix_timestamp("ts") / window_seconds) * window_seconds
    moved = progress_deltas(progress).groupBy(start.cast("bigint").alias("window_start")).agg(
        F.sum("delta").alias("bytes")
    )
    finished = progress.filter("done >= total").groupBy("path").agg(F.min("ts").alias("ts"))
    completed = finished.groupBy(start.cast("bigint").alias("window_start")).agg(
        F.count("*").alias("completed")
    )
    rate = F.col("bytes") / F.lit(float(window_seconds))
    return moved.join(completed, "window_start", "left").select(
        "window_start",
        "bytes",
        F.coalesce("completed", F.lit(0)).alias("completed"),
        human_size(rate, "/s").alias("rate"),
    )


def bench_summary(runs: DataFrame) -> DataFrame:
    """Mean, sample sd, min, max and worst code per (tool, scenario), and who is fastest.

    Tools within half a millisecond of the best mean of a scenario tie.
    """
    cells = runs.groupBy("tool", "scenario").agg(
        F.avg("seconds").alias("_mean"),
        F.round(F.avg("seconds"), 3).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("seconds"), F.lit(0.0)), 3).alias("sd"),
        F.min("seconds").alias("min"),
        F.max("seconds").alias("max"),
        F.max("rc").alias("worst_rc"),
    )
    best = cells.groupBy("scenario").agg(F.min("_mean").alias("_best"))
    fastest = F.col("_mean") <= F.col("_best") + TIE_SECONDS
    return cells.join(best, "scenario").select(
        "tool", "scenario", "mean", "sd", "min", "max", "worst_rc", fastest.alias("fastest")
    )
