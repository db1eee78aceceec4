"""Snapshots: apply, backups, publishing, retirement, resume; batching."""

import pytest
from pyspark.sql import functions as F

from sparksync.operators import apply, tiers
from sparksync.plans.deletes import DeleteLimitExceeded
from sparksync.plans.planner import plan_sync
from sparksync.run import SyncOptions, sync_table
from sparksync.streaming.watch import read_synced

COLS = "path string, kind string, size long, mode int, mtime_sec long, mtime_nsec int, content string"


def snap(spark, *rows):
    return spark.createDataFrame([(p, "file", len(c), m, t, 0, c) for p, c, m, t in rows], COLS)


@pytest.fixture
def pair(spark):
    src = snap(spark, ("new", "n", 420, 1), ("changed", "cc", 420, 1), ("chmod", "m", 493, 1), ("same", "s", 420, 1))
    dst = snap(spark, ("changed", "c", 420, 1), ("chmod", "M", 420, 1), ("same", "S", 420, 1), ("gone", "g", 420, 1))
    return src, dst


def as_dict(df):
    return {r["path"]: (r["content"], r["mode"]) for r in df.collect()}


def test_apply_plan(pair):
    src, dst = pair
    want = {"new": ("n", 420), "changed": ("cc", 420), "chmod": ("M", 493), "same": ("S", 420)}
    assert as_dict(apply.apply_plan(plan_sync(src, dst, delete=True), src, dst)) == want
    # Without deletes, entries the source does not name stay untouched.
    kept = as_dict(apply.apply_plan(plan_sync(src, dst), src, dst))
    assert kept == {**want, "gone": ("g", 420)}


def test_apply_is_idempotent(pair):
    src, dst = pair
    once = apply.apply_plan(plan_sync(src, dst, delete=True), src, dst)
    again = plan_sync(src, once, delete=True)
    assert [r["action"] for r in again.select("action").distinct().collect()] == ["skip"]


def test_backups(spark, pair):
    src, dst = pair
    dst = dst.union(snap(spark, ("gone~", "older", 420, 1)))
    plan = plan_sync(src, dst, delete=True).filter("path <> 'gone~'")
    backups = apply.backup_replaced(plan, dst)
    assert {p: c for p, (c, _) in as_dict(backups).items()} == {"changed~": "c", "gone~": "g"}
    full = as_dict(apply.with_backups(apply.apply_plan(plan, src, dst), backups))
    assert full["gone~"][0] == "g" and full["changed~"][0] == "c" and len(full) == 6


def test_publish_and_failed_publish(spark, pair, tmp_path):
    src, dst = pair
    place = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        apply.read_snapshot(spark, place)
    apply.publish_snapshot(dst, place)
    reader = apply.read_snapshot(spark, place)
    broken = src.withColumn("content", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception):
        apply.publish_snapshot(broken, place)
    assert as_dict(apply.read_snapshot(spark, place)) == as_dict(dst)
    assert not list((tmp_path / "table" / "_staging").iterdir())
    apply.publish_snapshot(src, place, compression="lz4")
    assert as_dict(apply.read_snapshot(spark, place)) == as_dict(src)
    # A reader that opened the old snapshot still sees it whole.
    assert as_dict(reader) == as_dict(dst)


def test_retire(spark):
    def scan(*rows):
        return spark.createDataFrame(rows, "path string, size long, mtime_sec long, mtime_nsec int, dereferenced boolean")

    names = ["ok", "touched", "external", "skipped", "mismatch", "unsent"]
    scanned = scan(*[(n, 1, 1, 0, n == "external") for n in names])
    current = scan(*[(n, 1, 2 if n == "touched" else 1, 0, n == "external") for n in names])
    sent = spark.createDataFrame([(n, "h") for n in names if n != "unsent"], "path string, hash string")
    got = spark.createDataFrame([(n, "x" if n == "mismatch" else "h") for n in names], "path string, hash string")
    skipped = spark.createDataFrame([("skipped",)], "path string")
    left = apply.retire_verified_sources(scanned, current, sent, got, skipped)
    assert sorted(r["path"] for r in left.collect()) == sorted(n for n in names if n != "ok")


def test_resume(pair, spark):
    src, dst = pair
    plan = plan_sync(src, dst, delete=True)
    ledger = spark.createDataFrame([("new", "create"), ("gone", "update")], "path string, action string")
    left = apply.resume_apply(plan, ledger)
    assert {r["path"] for r in left.collect()} == {"changed", "chmod", "gone"}


def test_pack_batches(spark):
    rows = spark.range(1000).select(
        F.format_string("p%04d", "id").alias("path"), (F.col("id") * 37 % 101).alias("size")
    )
    got = [(r["path"], r["batch"]) for r in tiers.pack_batches(rows, 500, parts=7).orderBy("path").collect()]
    total, want = 0, []
    for i in range(1000):
        want.append((f"p{i:04d}", total // 500))
        total += i * 37 % 101
    assert got == want


def test_tiers(spark):
    sizes = [0, 2 << 20, (2 << 20) + 1, 16 << 20, (16 << 20) + 1]
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    got = [r[0] for r in df.orderBy("s").select(tiers.classify_size(F.col("s"))).collect()]
    assert got == ["small", "small", "medium", "medium", "large"]
    strategy = lambda s, there: spark.range(1).select(tiers.choose_strategy(F.lit(s), F.lit(there))).first()[0]
    assert [strategy(10 << 20, True), strategy((10 << 20) + 1, True), strategy(1 << 30, False)] == ["copy", "delta", "copy"]


@pytest.fixture
def swapped(spark):
    """A file takes the place of a directory, and another file's content goes."""
    src = snap(spark, ("a", "file", 420, 1), ("ab/x", "x", 420, 1), ("e", "", 420, 1))
    dst = snap(spark, ("a/x", "x", 420, 1), ("a/b/y", "y", 420, 1), ("ab/x", "x", 420, 1), ("e", "full", 420, 1), ("a~/old", "o", 420, 1)).union(
        spark.createDataFrame([("a", "dir", 0, 493, 1, 0, ""), ("a/b", "dir", 0, 493, 1, 0, "")], COLS)
    )
    return src, dst


@pytest.mark.parametrize("flags", [{}, {"delete": True}, {"delete": True, "delete_scope": ["ab"]}])
def test_a_file_in_place_of_a_directory_clears_what_was_below(swapped, flags):
    src, dst = swapped
    plan = plan_sync(src, dst, **flags)
    rows = [(r["path"], r["action"], r["reason"]) for r in plan.collect()]
    assert len(rows) == len({p for p, _, _ in rows})
    assert {p for p, a, r in rows if r == "replaced"} == {"a/x", "a/b", "a/b/y"} and all(a == "delete" for _, a, r in rows if r == "replaced")
    kept = {"a", "ab/x", "e"} | (set() if flags == {"delete": True} else {"a~/old"})
    after = as_dict(apply.apply_plan(plan, src, dst))
    assert set(after) == kept and after["e"] == ("", 420)


def test_a_replaced_directory_is_backed_up_whole(swapped):
    src, dst = swapped
    plan = plan_sync(src, dst)
    backups = {r["path"]: (r["kind"], r["content"]) for r in apply.backup_replaced(plan, dst).collect()}
    assert backups == {"a~": ("dir", ""), "a~/x": ("file", "x"), "a~/b": ("dir", ""), "a~/b/y": ("file", "y"), "e~": ("file", "full")}


def test_what_a_replaced_directory_held_counts_as_deleted(swapped, tmp_path):
    src, dst = swapped
    place = str(tmp_path / "table")
    apply.publish_snapshot(dst, place)
    with pytest.raises(DeleteLimitExceeded):
        sync_table(src, place, SyncOptions(max_delete=2))
    sync_table(src, place, SyncOptions(max_delete=3, backup=True))
    assert set(as_dict(read_synced(src.sparkSession, place))) == {"a", "a~", "a~/x", "a~/b", "a~/b/y", "a~/old", "ab/x", "e", "e~"}
