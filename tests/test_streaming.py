"""Bursts in batch and stream, watch cycles."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sparksync.operators.apply import current_run, expire_runs
from sparksync.streaming import bursts, watch

EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def feed(spark, rows):
    """Events of (key, milliseconds)."""
    df = spark.createDataFrame([(k, int(ms)) for k, ms in rows], "key string, ms long")
    return df.select("key", F.timestamp_millis("ms").alias("ts"))


def brute(rows, delay, cap=None):
    out = {}
    for key in {k for k, _ in rows}:
        first = last = None
        for t in sorted(s for k, s in rows if k == key):
            if first is None or t - last > delay or (cap is not None and t - first >= cap):
                first = t
            last = t
            n = out.get((key, first), (0, 0))[1]
            out[(key, first)] = (last, n + 1)
    return out


def as_dict(df):
    ms = lambda c: F.unix_millis(c)
    return {
        (r["key"], r["f"]): (r["l"], r["events"])
        for r in df.select("key", ms("burst_start").alias("f"), ms("last_event").alias("l"), "events").collect()
    }


def random_rows(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for key, dense in (("hot", 1000), ("hot", 200), ("cold", 7000)):
        t = rnd.randrange(1, 50_000)
        for _ in range(n):
            t += int(rnd.choice([0, 0.25, 0.5, 1, 2, 3]) * dense)
            rows.append((key, t))
    # Times above zero: a stream drops events at or before its initial watermark.
    rows += [("edge", 1000), ("edge", 3000), ("edge", 5500), ("edge", 15_500)]
    rows += [("regular", 1000 + i * 500) for i in range(300)]
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("factor", [1, 3])
def test_bursts_equal_brute_force(spark, monkeypatch, seed, factor):
    """Small slices, so that bursts cross many of them."""
    monkeypatch.setattr(bursts, "SLICE_FACTOR", factor)
    rows = random_rows(seed)
    assert as_dict(bursts.debounce_bursts(feed(spark, rows), "key", 2.0)) == brute(rows, 2000)
    assert as_dict(bursts.debounce_capped(feed(spark, rows), "key", 2.0, 10.0)) == brute(rows, 2000, 10_000)
    # A cap below the quiet window is allowed too.
    assert as_dict(bursts.debounce_capped(feed(spark, rows), "key", 3.0, 2.0)) == brute(rows, 3000, 2000)


def test_session_stream_equals_batch(spark, tmp_path):
    rows = random_rows(5, 60)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, sorted(rows, key=lambda r: r[1])).coalesce(1).write.parquet(src)
    # A late event closes what is open.
    feed(spark, [("end", 1e9)]).write.mode("append").parquet(src)
    stream = spark.readStream.schema("key string, ts timestamp").parquet(src)
    for _ in range(2):  # the second run only advances the watermark
        q = (
            bursts.debounce_stream(stream, "key", "2 seconds", "1 hour").writeStream.outputMode("append")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
            .format("parquet").start(out)
        )
        q.awaitTermination()
        feed(spark, [("end", 2e9)]).write.mode("append").parquet(src)
    got = as_dict(spark.read.parquet(out).filter("key <> 'end'"))
    assert got == brute(rows, 2000)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_capped(spark, tmp_path, batches, delay, cap, watermark, **conf):
    """Each batch of (key, ms) as a file of its own, then far later events that let the watermark pass."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    conf = {"spark.sql.streaming.stateStore.providerClass": ROCKS, **conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for batch in [*batches, [("end", 1e9)], [("end", 2e9)]]:
            feed(spark, batch).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema("key string, ts timestamp").parquet(src)
            bursts.debounce_capped_stream(stream, "key", delay, cap, watermark).writeStream.outputMode("append").option(
                "checkpointLocation", str(tmp_path / "cp")
            ).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    finally:
        for k in conf:
            spark.conf.unset(k)
    return as_dict(spark.read.parquet(out).filter("key <> 'end'"))


def test_capped_stream_takes_events_in_any_order(spark, tmp_path):
    rows = random_rows(6, 60)
    random.Random(1).shuffle(rows)
    got = run_capped(spark, tmp_path, [rows[i::3] for i in range(3)], 2.0, 10.0, "1 hour")
    assert got == brute(rows, 2000, 10_000)


def test_capped_stream_with_small_batches(spark, tmp_path):
    """More events of a key than an Arrow batch holds, ties, and an event behind the watermark."""
    rows = [("k", 20_000), ("k", 21_000), ("k", 1_000), ("k", 2_500), ("k", 2_000), ("k", 2_500)]
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2"}
    got = run_capped(spark, tmp_path, [rows, [("k", 40_000)], [("k", 3_000), ("k", 41_000)]], 2.0, 10.0, "5 seconds", **conf)
    assert got == brute([*rows, ("k", 40_000), ("k", 41_000)], 2000, 10_000)


def test_capped_bursts_of_a_busy_key(spark):
    """No row per burst, slice or key holds that key's events, and a null key and null times are defined."""
    rows = [("busy", 1000 + i * 7 % 99_991) for i in range(6000)] + [(None, 1000), (None, 1500), (None, 12_000)]
    df = feed(spark, rows)
    got = as_dict(bursts.debounce_capped(df, "key", 2.0, 10.0))
    assert got == brute(rows, 2000, 10_000)
    plan = bursts.debounce_capped(df, "key", 2.0, 10.0)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Python" not in plan
    odd = df.unionByName(df.limit(1).withColumn("ts", F.lit(None).cast("timestamp")))
    assert as_dict(bursts.debounce_bursts(odd, "key", 2.0)) == brute(rows, 2000)
    assert bursts.debounce_capped(df.limit(0), "key", 2.0).collect() == []


CHANGE = "path string, kind string, size long, mode int, mtime_sec long, mtime_nsec int, content string, seq long, deleted boolean"


def change(path, content, seq, deleted=False):
    return (path, "file", len(content), 420, seq, 0, content, seq, deleted)


def snapshot(spark, place):
    return {r["path"]: r["content"] for r in watch.read_synced(spark, place).collect()}


def test_watch_cycles(spark, tmp_path):
    src, place = str(tmp_path / "in"), str(tmp_path / "table")
    add = lambda *rows: spark.createDataFrame(list(rows), CHANGE).coalesce(1).write.mode("append").parquet(src)
    add(change("a", "1", 1), change("b", "1", 2), change("a", "22", 3))
    stream = spark.readStream.schema(CHANGE).parquet(src)
    run = lambda **kw: watch.watch_sync(stream, place, str(tmp_path / "cp"), available_now=True, **kw).awaitTermination()
    run()
    assert snapshot(spark, place) == {"a": "22", "b": "1"}
    add(change("b", "", 4, True), change("c", "3", 5))
    run()
    assert snapshot(spark, place) == {"a": "22", "c": "3"}
    run()  # nothing new: no cycle
    assert snapshot(spark, place) == {"a": "22", "c": "3"}
    # Only the burst was written; the baseline is still the published one.
    first = current_run(spark, place)
    written = spark.read.parquet(f"{place}/changes/{first}")
    assert sorted(r["path"] for r in written.collect()) == ["b", "c"]
    # The same burst again changes nothing, under its own tag or another.
    tag = written.first()["tag"]
    for again in (tag, "other-0"):
        watch.apply_changes(spark.createDataFrame([change("b", "", 4, True), change("c", "3", 5)], CHANGE), place, again)
        assert snapshot(spark, place) == {"a": "22", "c": "3"}
    # A later batch wins over an earlier one, also for a deleted path.
    add(change("b", "back", 6), change("c", "", 7, True))
    run()
    assert snapshot(spark, place) == {"a": "22", "b": "back"}
    watch.compact(spark, place)
    assert snapshot(spark, place) == {"a": "22", "b": "back"}
    assert current_run(spark, place) != first
    assert expire_runs(spark, place, keep=1) == [first]
    assert snapshot(spark, place) == {"a": "22", "b": "back"}


def test_a_file_takes_the_place_of_a_directory(spark, tmp_path):
    """Over several batches and a second start nothing is left below the file."""
    src, place = str(tmp_path / "in"), str(tmp_path / "table")
    folder = lambda path, seq: (path, "dir", 0, 493, seq, 0, "", seq, False)
    add = lambda *rows: spark.createDataFrame(list(rows), CHANGE).coalesce(1).write.mode("append").parquet(src)
    base = spark.createDataFrame([folder("a", 0), change("a/x", "1", 0), change("a/b/y", "2", 0), change("ab", "3", 0)], CHANGE).drop("seq", "deleted")
    add(change("a", "file", 1))
    stream = spark.readStream.schema(CHANGE).parquet(src)
    run = lambda: watch.watch_sync(stream, place, str(tmp_path / "cp"), baseline=base, available_now=True).awaitTermination()
    run()
    assert snapshot(spark, place) == {"a": "file", "ab": "3"}
    add(folder("a", 2), change("a/new", "", 3))
    run()
    assert snapshot(spark, place) == {"a": "", "a/new": "", "ab": "3"}
    add(change("a", "again", 4), change("ab", "", 5, True))
    run()
    assert snapshot(spark, place) == {"a": "again"}


def test_second_start_keeps_applied_changes(spark, tmp_path):
    src, place = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame([change("a", "22", 1), change("b", "", 2, True)], CHANGE).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(CHANGE).parquet(src)
    baseline = spark.createDataFrame([change("a", "1", 0), change("b", "1", 0)], CHANGE).drop("seq", "deleted")
    for _ in range(2):
        watch.watch_sync(stream, place, str(tmp_path / "cp"), baseline=baseline, available_now=True).awaitTermination()
        assert snapshot(spark, place) == {"a": "22"}


def test_failed_cycle_is_retried(spark, tmp_path):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError

    watch.retry_cycle(flaky, attempts=3, backoff=0)
    assert len(calls) == 3
    calls.clear()
    with pytest.raises(ConnectionError):
        watch.retry_cycle(flaky, attempts=2, backoff=0)


def test_bounded_watch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([change("a", "1", 1)], CHANGE).write.parquet(src)
    stream = spark.readStream.schema(CHANGE).parquet(src)
    q = watch.watch_sync(stream, str(tmp_path / "t"), str(tmp_path / "cp"), processing_time="1 second")
    assert watch.bounded_watch(q, "4s") is False
    assert not q.isActive


def test_watch_ends_when_nothing_comes(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([change("a", "1", 1)], CHANGE).write.parquet(src)
    stream = spark.readStream.schema(CHANGE).parquet(src)
    q = watch.watch_sync(stream, str(tmp_path / "t"), str(tmp_path / "cp"), processing_time="1 second")
    assert watch.bounded_watch(q, "5m", idle="3s") is False
    assert snapshot(spark, str(tmp_path / "t")) == {"a": "1"}


def test_totals_write_what_changed(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    shape = "action string, source_size long"
    for rows in ([("create", 1), ("update", 5)], [("create", 2)], [("create", 3), ("delete", None)]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(shape).parquet(src)
        watch.keep_totals(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in watch.read_totals(spark, out).collect()} == {("create", 3, 6), ("update", 1, 5), ("delete", 1, 0)}
    assert [r.action for r in spark.read.parquet(f"{out}/batch=1").collect()] == ["create"]


def test_parse_duration():
    good = {"1h30m": 5400, "45s": 45, "1d 2h": 93600, "90": 90, " 2M ": 120, "1h5": 3605}
    assert {k: watch.parse_duration(k) for k in good} == good
    for bad in ("", "0", "h", "5x", "0s", "-1"):
        with pytest.raises(ValueError):
            watch.parse_duration(bad)
