"""One sync run from end to end: filter, plan, guard, apply, publish, verify, report."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, functions as F

from sparksync.functions.content import strong_hash
from sparksync.operators.apply import (
    apply_plan,
    backup_replaced,
    bucket_of,
    current_run,
    publish_snapshot,
)
from sparksync.operators.filters import quarantine_unsafe_paths, tree_filter
from sparksync.operators.reports import sync_stats, verify_report
from sparksync.operators.tiers import DELTA_MIN
from sparksync.operators.transfer import transfer_contents
from sparksync.plans.deletes import protect_from_delete, refuse_above
from sparksync.plans.pairing import PAIR_MIN_BYTES
from sparksync.plans.planner import plan_sync
from sparksync.session import checkpointed
from sparksync.streaming.watch import append_versions, compact, read_synced


@dataclass(frozen=True)
class SyncOptions:
    """Switches of a run; ``flags`` are the planner's decision flags."""

    includes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    delete: bool = False
    delete_scope: list[str] | None = None
    max_delete: int | None = None
    backup: bool = False
    verify: bool = False
    dry_run: bool = False
    #: Make updated content from its old version or a sibling where that pays; sizes are in bytes.
    delta: bool = False
    delta_min: int = DELTA_MIN
    pair_min: int = PAIR_MIN_BYTES
    #: Changed rows are written on top of the snapshot; after so many runs a whole one is published.
    compact_every: int = 100
    #: Hash buckets of a new table; changes then commit one group of buckets after the other.
    buckets: int = 0
    groups: int = 1
    compression: str = "snappy"
    flags: dict[str, bool] = field(default_factory=dict)


@dataclass(frozen=True)
class SyncResult:
    """What a run planned and did. All parts are DataFrames except the run id."""

    plan: DataFrame
    skipped: DataFrame
    stats: DataFrame
    verification: DataFrame | None
    run: str | None
    transfers: DataFrame | None = None


def sync_table(
    source: DataFrame, location: str, options: SyncOptions = SyncOptions(), skipped: DataFrame | None = None
) -> SyncResult:
    """Bring the table published at ``location`` in step with ``source``.

    ``source`` is a manifest with a ``content`` column. ``skipped`` lists
    (path, reason) a scan left out by policy; what lies there is never
    deleted. Nothing is written in a dry run or when the delete guard objects.
    """
    spark = source.sparkSession
    usable, unsafe = quarantine_unsafe_paths(tree_filter(source, options.includes, options.excludes))
    held = unsafe.select("path", F.col("unsafe").alias("reason"))
    skipped = held if skipped is None else held.unionByName(skipped.select("path", "reason"))

    exists = current_run(spark, location) is not None
    dst = read_synced(spark, location) if exists else usable.limit(0)
    # Each step below reads the plan, which is small beside the content; deletes are counted while it is written.
    counts, count_deletes = Observation(), F.count_if(F.col("action") == "delete").alias("deletes")
    plan = plan_sync(usable, dst, delete=options.delete, delete_scope=options.delete_scope, **options.flags)
    plan = checkpointed(plan.observe(counts, count_deletes))
    if options.delete:
        # What a replaced directory held cannot stay, so nothing protects it.
        open_ = (F.col("action") == "delete") & (F.col("reason") != "replaced")
        allowed = protect_from_delete(plan.filter(open_), skipped, options.includes, options.excludes)
        counts = Observation()
        plan = checkpointed(plan.filter(~open_).unionByName(allowed.select(*plan.columns)).observe(counts, count_deletes))
    if options.max_delete is not None:
        refuse_above(counts.get["deletes"], options.max_delete)
    stats = sync_stats(plan, skipped)
    if options.dry_run:
        return SyncResult(plan, skipped, stats, None, None)

    transfers = None
    if options.delta and exists:
        transfers = transfer_contents(plan, usable, dst, options.delta_min, options.pair_min)
        # Every file that changes has its content there, so the source's need not be shuffled beside it.
        other = F.when(~F.col("kind").eqNullSafe("file"), F.col("content")).alias("content")
        usable = usable.select(*[other if c == "content" else c for c in usable.columns])
        usable = usable.join(transfers.select("path", F.col("content").alias("_made")), "path", "left").withColumn(
            "content", F.coalesce("_made", "content")
        ).drop("_made")
    backups = backup_replaced(plan, dst) if options.backup else None
    if exists:
        run = append_plan(plan, usable, dst, backups, location, options)
    else:
        run = publish_snapshot(apply_plan(plan, usable, dst), location, options.compression, options.buckets)
    verification = _verify(plan, usable, location, skipped) if options.verify else None
    return SyncResult(plan, skipped, stats, verification, run, transfers)


def append_plan(plan: DataFrame, src: DataFrame, dst: DataFrame, backups: DataFrame | None, location: str, options: SyncOptions) -> str:
    """Write changed rows, and only those, on top of the published snapshot.

    Groups of buckets are committed one after the other, each with its part of
    the ledger. A run that ends between two of them leaves whole groups; the
    next run plans against these and goes on with the rest.
    """
    todo = plan.filter("action <> 'skip'")
    fixed = todo.filter("action = 'meta'").select("path")
    versions = apply_plan(todo, src, dst.join(fixed, "path", "left_semi")).withColumn("deleted", F.lit(False))
    rows = versions.unionByName(todo.filter("action = 'delete'").select("path", F.lit(True).alias("deleted")), allowMissingColumns=True)
    if backups is not None:
        rows = rows.join(backups.select("path"), "path", "left_anti").unionByName(backups.withColumn("deleted", F.lit(False)), allowMissingColumns=True)
    spark, run = plan.sparkSession, uuid.uuid4().hex
    if todo.isEmpty():
        return current_run(spark, location)
    # The action stays with the row: what is written is also the ledger of what was done.
    rows = rows.select(*dst.columns, "deleted").join(todo.select("path", "action"), "path", "left")
    if options.groups > 1:
        rows = checkpointed(rows)
    for group in range(options.groups):
        part = rows.filter(bucket_of(F.col("path"), options.groups) == group) if options.groups > 1 else rows
        turn = append_versions(part, location, f"{run}-{group}", options.compression)
    if turn >= options.compact_every:
        compact(spark, location)
    return run


def _verify(plan: DataFrame, source: DataFrame, location: str, skipped: DataFrame) -> DataFrame:
    """Hash what was sent against what can now be read back."""
    sent = plan.filter(F.col("action").isin("create", "update")).select("path")
    hashed = lambda df: df.join(sent, "path", "left_semi").select(
        "path", strong_hash(F.col("content").cast("binary")).alias("hash")
    )
    return verify_report(hashed(source), hashed(read_synced(source.sparkSession, location)), skipped)
