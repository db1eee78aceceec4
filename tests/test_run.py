"""A whole run through the front door."""

import random
import re

import pytest

from sparksync import run
from sparksync.operators.apply import read_snapshot
from sparksync.plans.deletes import DeleteLimitExceeded
from sparksync.run import SyncOptions, sync_table
from sparksync.streaming.watch import applied_ledger, apply_changes, compact, read_synced

COLS = "path string, kind string, size long, mode int, mtime_sec long, mtime_nsec int, content string"


def test_runs(spark, tmp_path):
    place = str(tmp_path / "table")

    def tree(**files):
        rows = [(p.replace("__", "/"), "file", len(c), 420, 100 + len(c), 0, c) for p, c in files.items()]
        return spark.createDataFrame(rows, COLS)

    def state():
        return {r["path"]: r["content"] for r in read_synced(spark, place).collect()}

    first = sync_table(tree(a="1", d__b="22", tmp__x="333"), place, SyncOptions(excludes=["tmp"], verify=True))
    assert state() == {"a": "1", "d/b": "22"}
    assert first.stats.first().asDict() == {"files": 2, "bytes": 3, "skipped": 0}
    assert {r["status"] for r in first.verification.collect()} == {"ok"}

    newer = tree(a="changed", c="new")
    options = SyncOptions(delete=True, max_delete=0)
    with pytest.raises(DeleteLimitExceeded):
        sync_table(newer, place, options)
    assert state() == {"a": "1", "d/b": "22"}

    dry = sync_table(newer, place, SyncOptions(delete=True, dry_run=True))
    assert {r["path"]: r["action"] for r in dry.plan.collect()} == {"a": "update", "c": "create", "d/b": "delete"}
    assert state() == {"a": "1", "d/b": "22"}

    policy = spark.createDataFrame([("d", "link skipped")], "path string, reason string")
    kept = sync_table(newer, place, SyncOptions(delete=True, backup=True), policy)
    assert state() == {"a": "changed", "a~": "1", "c": "new", "d/b": "22"}
    assert kept.stats.first()["skipped"] == 1


def test_only_changed_rows_are_written(spark, tmp_path):
    place = str(tmp_path / "table")
    rows = [(f"d/{i}", "file", 2, 420, 100, 0, "xx") for i in range(50)]
    sync_table(spark.createDataFrame(rows, COLS), place)
    rows[7] = ("d/7", "file", 3, 420, 101, 0, "yyy")
    result = sync_table(spark.createDataFrame(rows, COLS), place)
    written = spark.read.parquet(f"{place}/changes").select("path", "content", "deleted").collect()
    assert [tuple(r) for r in written] == [("d/7", "yyy", False)]
    assert {r["path"]: r["content"] for r in read_synced(spark, place).collect()} == {r[0]: r[6] for r in rows}
    assert result.run is not None
    # Nothing to do: nothing is written.
    sync_table(spark.createDataFrame(rows, COLS), place)
    assert spark.read.parquet(f"{place}/changes").count() == 1
    # After so many runs a whole snapshot is published.
    rows[8] = ("d/8", "file", 3, 420, 101, 0, "zzz")
    sync_table(spark.createDataFrame(rows, COLS), place, SyncOptions(compact_every=2))
    assert {r["path"]: r["content"] for r in read_snapshot(spark, place).collect()} == {r[0]: r[6] for r in rows}


def test_chained_bases(spark, tmp_path):
    """A row whose basis is made in this run waits for it; poor matches and new files are copied."""
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh") for _ in range(60_000))
    mid = base[:20_000] + "X" * 500 + base[20_500:]
    end = mid[:50_000] + "Y" * 500 + mid[50_500:]
    other = "".join(rnd.choice("abcdefgh") for _ in range(60_000))
    old = {"own": base, "seed": "s"}
    new = {"own": end, "seed": "s", "v/1.iso": base, "v/1.1.iso": mid, "v/1.1.1.iso": end, "w/2.iso": base, "w/2.2.iso": other, "small": "tiny"}
    frame = lambda files, t: spark.createDataFrame([(p, "file", len(c), 420, t, 0, c) for p, c in files.items()], COLS)
    place = str(tmp_path / "table")
    sync_table(frame(old, 1), place)
    result = sync_table(frame(new, 2), place, SyncOptions(delta=True, delta_min=10_000, pair_min=10_000, verify=True))
    assert {r["path"]: r["content"] for r in read_synced(spark, place).collect()} == new
    got = {r["path"]: (r["how"], r["basis_path"], r["reason"]) for r in result.transfers.collect()}
    # In plan order 1.1.1.iso comes first, 1.1.iso is made from it and 1.iso from that.
    deltas = {p: b for p, (how, b, _) in got.items() if how == "delta"}
    assert deltas.pop("own") == "own" and len(deltas) == 2
    assert all(b.startswith("v/") and p.startswith("v/") for p, b in deltas.items())
    assert sum(reason == "dissimilar" for _, _, reason in got.values()) == 1
    assert all(r["bytes_matched"] + r["bytes_literal"] == len(new[r["path"]]) for r in result.transfers.collect())
    assert {r["status"] for r in result.verification.collect()} == {"ok"}


def test_a_run_that_ends_between_groups_goes_on_with_the_rest(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "table")
    rows = lambda n, c: spark.createDataFrame([(f"d/{i}", "file", len(c), 420, len(c), 0, c) for i in range(n)], COLS)
    sync_table(rows(40, "xx"), place, SyncOptions(buckets=8))
    real, calls = run.append_versions, []

    def dies(*args):
        calls.append(args[2])
        if len(calls) == 3:
            raise ConnectionError("lost")
        return real(*args)

    monkeypatch.setattr(run, "append_versions", dies)
    with pytest.raises(ConnectionError):
        sync_table(rows(40, "yyy"), place, SyncOptions(groups=4))
    done = {r.path for r in applied_ledger(spark, place, calls[0].partition("-")[0]).collect()}
    state = {r.path: r.content for r in read_synced(spark, place).collect()}
    assert 0 < len(done) < 40 and {p for p, c in state.items() if c == "yyy"} == done
    second = sync_table(rows(40, "yyy"), place, SyncOptions(groups=4))
    assert {r.path for r in second.plan.filter("action = 'update'").collect()} == set(state) - done
    assert {r.content for r in read_synced(spark, place).collect()} == {"yyy"}


def test_only_the_buckets_of_a_burst_are_read(spark, tmp_path):
    place = str(tmp_path / "table")
    rows = [(f"d/{i}", "file", 2, 420, 100, 0, "xx") for i in range(200)]
    sync_table(spark.createDataFrame(rows, COLS), place, SyncOptions(buckets=32))
    burst = spark.createDataFrame([("d/7", "file", 3, 420, 100, 0, "yyy", 1, False)], COLS + ", seq long, deleted boolean")
    nothing = spark.createDataFrame([(*rows[9], 0, False)], burst.schema)
    apply_changes(nothing, place, "t-n")
    apply_changes(burst, place, "t-0")
    few = read_synced(spark, place, touching=burst)
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", few._jdf.queryExecution().sparkPlan().toString())
    assert len(scans) >= 2 and all("_bucket" in filters for filters in scans)
    assert 0 < few.count() < 40
    assert few.filter("path = 'd/7'").count() == 1 and read_synced(spark, place).count() == 200
    compact(spark, place)
    assert read_synced(spark, place, touching=burst).count() == few.count()
    # What lies in the staging folder only is not read.
    (tmp_path / "table" / "_staging" / "half").mkdir()
    assert read_synced(spark, place).count() == 200


def test_a_reader_of_few_columns_reads_no_content(spark, tmp_path, capsys):
    place = str(tmp_path / "table")
    for text in ("one", "three"):
        sync_table(spark.createDataFrame([("a", "file", len(text), 420, len(text), 0, text)], COLS), place)
    state = read_synced(spark, place)
    assert [tuple(r) for r in state.select("path", "size", "content").collect()] == [("a", 5, "three")]
    state.select("path", "size").explain()
    assert "content" not in capsys.readouterr().out


def test_content_of_a_run_is_shuffled_in_one_place(spark, tmp_path, monkeypatch):
    place, seen = str(tmp_path / "table"), []
    monkeypatch.setattr(run, "append_plan", lambda plan, usable, *rest: seen.append(usable))
    frame = lambda text: spark.createDataFrame([(p, "file", len(text) + n, 420, len(text), 0, text + p * n) for p, n in (("a", 0), ("b", 1))], COLS)
    sync_table(frame("one"), place)
    result = sync_table(frame("three"), place, SyncOptions(delta=True, delta_min=2, pair_min=2))
    assert {r.path: r.content for r in result.transfers.collect()} == {r.path: r.content for r in seen[0].collect()} == {"a": "three", "b": "threeb"}
    # The source side of the join brings content of directories and links only.
    bare = result.transfers.select("path").limit(0)
    assert "CASE WHEN" in seen[0].join(bare, "path", "left_anti")._jdf.queryExecution().optimizedPlan().toString()
