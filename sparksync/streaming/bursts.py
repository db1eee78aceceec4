"""Change bursts: events closer than a quiet window belong together.

Events are never gathered by key. A bin is a stretch of time as long as the
quiet window, so a bin of a key holds no gap and is summed up as (first, last,
n) before the shuffle. Bursts are runs of bins. A key has at most as many bins
as the calendar has quiet windows, however many events it has.

Capped bursts also depend on where the one before began. Every event of a long
run points to the event that would open the next burst; these pointers are
composed over growing blocks of time, and the bursts that really occur are
then read back from the largest block down to the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from sparksync.session import checkpointed

#: Bins whose runs are found in one window.
SLICE_FACTOR = 4096
#: Cells per cap; the next event is looked for in a cell, then in the cells of a slice, then in the slices.
CELLS = 1024
#: A block is made of two to this power blocks of the level below.
BLOCK_BITS = 2
# Fixed value: seconds after which a burst ends where no other cap is asked for.
COALESCE_CAP_SECONDS = 10


def _micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def _timed(events: DataFrame, key: str) -> DataFrame:
    """(id, us); a null key is a key like others, events without a time are left out."""
    return events.filter(F.col("ts").isNotNull()).select(F.struct(F.col(key).alias("key")).alias("id"), F.unix_micros("ts").alias("us"))


def _bin(us: Column, quiet: int) -> Column:
    return F.floor(us / max(quiet, 1)).cast("long")


def _numbered(df: DataFrame, part: list[str], quiet: int) -> DataFrame:
    """``df`` with ``run``: how many gaps longer than ``quiet`` lie before a row in its part."""
    timeline = W.partitionBy(*part).orderBy("first")
    new = F.coalesce((F.col("first") - F.lag("last").over(timeline) > quiet).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(timeline)).drop("_new")


def _quiet_runs(events: DataFrame, key: str, quiet: int) -> tuple[DataFrame, DataFrame]:
    """Runs of events without a gap longer than ``quiet``, and which runs the bins belong to.

    The first is (id, slice, run, start, last, n, whole): a run that goes on in
    other slices has a row in each of them, with the same ``start`` and
    totals, and one of them is ``whole``. The second is (id, bin, slice, run).
    """
    bins = _timed(events, key).groupBy("id", _bin(F.col("us"), quiet).alias("bin")).agg(
        F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("n")
    )
    local = _numbered(bins.withColumn("slice", F.floor(F.col("bin") / SLICE_FACTOR).cast("long")), ["id", "slice"], quiet)
    runs = local.groupBy("id", "slice", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")
    )
    edge = (F.col("run") == 0) | (F.col("run") == F.max("run").over(W.partitionBy("id", "slice")))
    runs = runs.withColumn("edge", edge)
    # Runs at the edge of a slice, joined across slices: two rows a slice.
    edges = _numbered(runs.filter("edge").withColumnRenamed("run", "own"), ["id"], quiet)
    over = W.partitionBy("id", "run")
    first_of = F.row_number().over(over.orderBy("first")) == 1
    edges = edges.select(
        "id", "slice", F.col("own").alias("run"), F.min("first").over(over).alias("start"), F.max("last").over(over).alias("last"),
        F.sum("n").over(over).alias("n"), first_of.alias("whole"),
    )
    inner = runs.filter("not edge").select("id", "slice", "run", F.col("first").alias("start"), "last", "n", F.lit(True).alias("whole"))
    return edges.unionByName(inner), local.select("id", "bin", "slice", "run")


def debounce_bursts(events: DataFrame, key: str, delay: float) -> DataFrame:
    """Batch bursts per key: a gap longer than ``delay`` seconds starts a new one."""
    runs, _ = _quiet_runs(events, key, _micros(delay))
    return _as_bursts(runs.filter("whole").select("id", "start", "last", "n"), key)


def _as_bursts(df: DataFrame, key: str) -> DataFrame:
    return df.select(
        F.col("id.key").alias(key),
        F.timestamp_micros("start").alias("burst_start"),
        F.timestamp_micros("last").alias("last_event"),
        F.col("n").alias("events"),
    )


def debounce_stream(events: DataFrame, key: str, delay: str, watermark: str) -> DataFrame:
    """The streaming form: session windows, state bounded by a watermark."""
    window = F.session_window("ts", delay)
    return (
        events.withWatermark("ts", watermark)
        .groupBy(key, window.alias("_w"))
        .agg(F.max("ts").alias("last_event"), F.count("*").alias("events"))
        .select(key, F.col("_w.start").alias("burst_start"), "last_event", "events")
    )


# --- capped bursts -----------------------------------------------------------

ISLAND = ["id", "start"]


def debounce_capped(events: DataFrame, key: str, delay: float, cap: float = COALESCE_CAP_SECONDS) -> DataFrame:
    """Batch bursts that also end ``cap`` seconds after their start; the next event opens a new one.

    A run of events shorter than ``cap`` is a burst as it is. In a longer one
    each distinct event time gets a pointer to the first event at or after
    ``cap`` later. Time from the run's start is dealt in slices of length
    ``cap``, so at most one burst begins in a slice. For blocks of 1, 4, 16, ...
    slices the pointers are composed: where does a burst that enters the block
    here leave it? Only events in a block's first slice, or the first event
    after it, can be entered on, so a level has a quarter of the rows below it.
    """
    quiet, limit = _micros(delay), max(_micros(cap), 1)
    runs, bins = _quiet_runs(events, key, quiet)
    runs = checkpointed(runs)
    long_ = F.col("last") - F.col("start") >= limit
    short = runs.filter(F.col("whole") & ~long_).select("id", "start", "last", "n")
    where = bins.join(runs.filter(long_), ["id", "slice", "run"]).select("id", "bin", "start", F.col("last").alias("run_last"))
    times = _timed(events, key).groupBy("id", "us").agg(F.count("*").alias("n")).withColumn("bin", _bin(F.col("us"), quiet))
    slice_of = lambda us: F.floor((us - F.col("start")) / limit).cast("long")
    times = checkpointed(times.join(where, ["id", "bin"]).select(*ISLAND, "us", "n", "run_last", slice_of(F.col("us")).alias("slice")))
    slices = times.groupBy(*ISLAND, "slice").agg(F.min("us").alias("first"))
    slices = checkpointed(slices.withColumn("before", F.lag("slice").over(W.partitionBy(*ISLAND).orderBy("slice"))))
    starts = _burst_starts(_pointers(times, slices, limit), slices)
    # The burst that is open when a slice begins, and the one that begins in it.
    earlier = W.partitionBy(*ISLAND).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    opened = slices.select(*ISLAND, "slice").join(starts.withColumnRenamed("us", "begun"), [*ISLAND, "slice"], "left").withColumn("open", F.max("begun").over(earlier))
    burst = F.when(F.col("us") >= F.col("begun"), F.col("begun")).otherwise(F.col("open"))
    cut = times.join(opened, [*ISLAND, "slice"]).groupBy("id", burst.alias("burst")).agg(F.max("us").alias("last"), F.sum("n").alias("n"))
    return _as_bursts(short.unionByName(cut.withColumnRenamed("burst", "start")), key)


def _pointers(times: DataFrame, slices: DataFrame, limit: int) -> DataFrame:
    """(id, start, us, slice, next, next_slice): the first event of the run at or after us + limit, null where there is none."""
    width = max(limit // CELLS, 1)
    at = lambda us: [F.floor((us - F.col("start")) / limit).cast("long").alias("slice"), F.floor((us - F.col("start")) / width).cast("long").alias("cell")]
    due = F.col("us") + limit
    found = times.select(*ISLAND, *at(F.col("us")), F.col("us").alias("at"), F.col("us").alias("event"), F.lit(None).cast("long").alias("asked"))
    asked = times.filter(due <= F.col("run_last")).select(*ISLAND, *at(due), due.alias("at"), F.lit(None).cast("long").alias("event"), F.col("us").alias("asked"))
    back = lambda *part: W.partitionBy(*ISLAND, *part)
    # Backwards in time the smallest event so far is the nearest one; an event at the same time comes first.
    near = F.min("event").over(back("slice", "cell").orderBy(F.desc("at"), F.asc_nulls_first("asked")).rowsBetween(W.unboundedPreceding, 0))
    both = found.unionByName(asked)
    asked = both.withColumn("near", near).filter(F.col("asked").isNotNull())
    strictly = lambda *part, by: back(*part).orderBy(F.desc(by)).rowsBetween(W.unboundedPreceding, -1)
    cells = both.groupBy(*ISLAND, "slice", "cell").agg(F.min("event").alias("first")).withColumn("in_slice", F.min("first").over(strictly("slice", by="cell")))
    later = both.groupBy(*ISLAND, "slice").agg(F.min("event").alias("first")).withColumn("in_run", F.min("first").over(strictly(by="slice")))
    # Within a slice cells differ and spread a busy run; of the slices there are as many as the calendar has caps.
    known = asked.join(cells.select(*ISLAND, "slice", "cell", "in_slice"), [*ISLAND, "slice", "cell"]).join(later.select(*ISLAND, "slice", "in_run"), [*ISLAND, "slice"])
    nexts = known.select(*ISLAND, F.col("asked").alias("us"), F.coalesce("near", "in_slice", "in_run").alias("next"))
    slice_of = lambda us: F.floor((us - F.col("start")) / limit).cast("long")
    return times.select(*ISLAND, "us", "slice").join(nexts, [*ISLAND, "us"], "left").withColumn("next_slice", slice_of(F.col("next")))


def _burst_starts(pointers: DataFrame, slices: DataFrame) -> DataFrame:
    """(id, start, us, slice) of the events that open a burst, by composing pointers over blocks of slices."""
    firsts = slices.select(*ISLAND, F.col("first").alias("us"), "before", F.lit(True).alias("is_first"))
    level = checkpointed(pointers.join(firsts, [*ISLAND, "us"], "left"))
    top = level.agg(F.max("slice")).first()[0]
    levels, k = [level], 0
    while top is not None and (top >> k) > 0:
        k += BLOCK_BITS
        block = lambda c: F.shiftright(c, k)  # noqa: B023, E731
        at_once = F.col("before").isNull() | (block("before") < block("slice")) | (F.col("before") % (1 << k) == 0)
        enters = (F.col("slice") % (1 << k) == 0) | (F.col("is_first") & at_once)
        onward = level.select(*ISLAND, F.col("us").alias("next"), F.col("next").alias("far"), F.col("next_slice").alias("far_slice"), F.lit(True).alias("known"))
        met = level.filter(enters)
        for _ in range((1 << BLOCK_BITS) - 1):
            inside = F.col("known") & (block("next_slice") == block("slice"))
            met = met.join(onward, [*ISLAND, "next"], "left").select(
                *ISLAND, "us", "slice", F.when(inside, F.col("far")).otherwise(F.col("next")).alias("next"),
                F.when(inside, F.col("far_slice")).otherwise(F.col("next_slice")).alias("next_slice"), "before", "is_first",
            )
        level = checkpointed(met)
        levels.append(level)
    begun = slices.filter("slice = 0").select(*ISLAND, F.col("first").alias("us"), "slice")
    for i in range(len(levels) - 2, -1, -1):
        pointer, latest = levels[i].select(*ISLAND, "us", "next", "next_slice"), begun
        for _ in range((1 << BLOCK_BITS) - 1):
            step = latest.join(pointer, [*ISLAND, "us"])
            same = F.shiftright("slice", BLOCK_BITS * (i + 1)) == F.shiftright("next_slice", BLOCK_BITS * (i + 1))
            latest = step.filter(same).select(*ISLAND, F.col("next").alias("us"), F.col("next_slice").alias("slice"))
            begun = begun.unionByName(latest)
        begun = checkpointed(begun)
    return begun


class CappedBursts(StatefulProcessor):
    """Streaming capped bursts: arrivals wait in a buffer until the watermark has passed them, and are then taken in order.

    The order in which files and micro-batches bring a key's events does not
    matter. State per key is the buffer, that is what arrived within the
    watermark delay, and one open burst.
    """

    def __init__(self, delay: float, cap: float):
        self.quiet = _micros(delay)
        self.cap = _micros(cap)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        longs = lambda *names: StructType([StructField(c, LongType()) for c in names])
        self.waiting = handle.getListState("waiting", longs("us", "n"))
        self.open = handle.getValueState("open", longs("first", "last", "n"))
        self.timer = handle.getValueState("timer", longs("ms"))

    def _wake(self, us: int) -> None:
        """Ask to be called when the watermark has passed ``us``; an earlier call that is due stays."""
        ms = us // 1000 + 1
        if self.timer.exists():
            due = self.timer.get()[0]
            if due <= ms:
                return
            self.handle.deleteTimer(due)
        self.timer.update((ms,))
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for batch in rows:
            counts = batch["us"].value_counts()
            self.waiting.appendList([(int(us), int(n)) for us, n in counts.items()])
            low = int(counts.index.min())
            least = low if least is None else min(least, low)
        self._wake(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [w for w in waiting if w[0] <= passed]
        state, done = self.open.get() if self.open.exists() else None, []
        for us, n in ready:
            if state is not None and us - state[1] <= self.quiet and us < state[0] + self.cap:
                state = (state[0], us, state[2] + n)
            else:
                if state is not None:
                    done.append(state)
                state = (us, us, n)
        # What may still come is later than the watermark.
        if state is not None and passed >= min(state[1] + self.quiet, state[0] + self.cap - 1):
            done.append(state)
            state = None
        self.waiting.clear()
        if waiting[len(ready) :]:
            self.waiting.put(waiting[len(ready) :])
        if state is not None:
            self.open.update(state)
        else:
            self.open.clear()
        due = [waiting[len(ready)][0]] if len(ready) < len(waiting) else []
        if state is not None:
            due.append(min(state[1] + self.quiet, state[0] + self.cap))
        if due:
            self._wake(min(due))
        if done:
            first, last, n = zip(*done, strict=True)
            yield pd.DataFrame({"key": key[0], "first_us": first, "last_us": last, "events": n})

    def close(self) -> None:
        pass


def debounce_capped_stream(
    events: DataFrame, key: str, delay: float, cap: float = COALESCE_CAP_SECONDS, watermark: str = "1 hour"
) -> DataFrame:
    """Capped bursts on a stream, whatever order events come in; needs the RocksDB state store.

    (key, burst_start, last_event, events). A burst is put out when the
    watermark shows that nothing can join it. Events behind the watermark when
    they arrive are dropped, as everywhere in Structured Streaming.
    """
    key_type = events.schema[key].dataType.simpleString()
    keyed = events.withWatermark("ts", watermark).select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("us"))
    found = keyed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=CappedBursts(delay, cap),
        outputStructType=f"key {key_type}, first_us bigint, last_us bigint, events bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    return found.select(
        F.col("key").alias(key), F.timestamp_micros("first_us").alias("burst_start"), F.timestamp_micros("last_us").alias("last_event"), "events"
    )
