"""The registered queries: every operator on the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparksync.operators import apply, blobs, cache, delta, filters, link_targets, links, reports, signatures, tiers
from sparksync.plans import deletes, diff, pairing, planner
from sparksync import run
from sparksync.session import checkpointed, scratch_path
from sparksync.sources import manifest, roots, samples
from sparksync.streaming import bursts, watch

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

BLOCK = 64


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _src(spark, d):
    return samples.src_manifest(spark, d)


def _dst(spark, d):
    return samples.dst_manifest(spark, d)


def _docs(spark, d):
    return samples.table(spark, d, "documents")


def _contents(spark, d):
    """Documents as (path, source, content) for work that is heavy per row."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id"), F.lit(".txt")))
    return _docs(spark, d).select("doc_id", "source", path.alias("path"), F.col("text").alias("content"))


# --- scans and sources -------------------------------------------------------


@query
def hash_manifest(spark, d):
    entries = samples.tree_manifest(spark, d).join(
        _dst(spark, d).select("path", "content"), "path", "left"
    )
    return manifest.hash_table_manifest(entries).select("path", "kind", "hash")


@query
def table_manifest(spark, d):
    df = _docs(spark, d)
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id"), F.lit(".txt")))
    return manifest.table_manifest(
        df, path, F.col("text"), F.col("doc_id") * 60 + 1700000000, F.col("doc_id") % 1000
    )


@query
def probe_destination(spark, d):
    return manifest.probe_destination(_dst(spark, d), _src(spark, d)).select("path", "size", "hash")


def _some_roots(spark, d):
    docs = _docs(spark, d)
    return (
        docs.filter(F.col("source").like("%1")).select(F.col("source").alias("root"))
        .union(docs.filter("lang = 'en'").select(F.concat_ws("/", "source", "lang")))
        .union(_src(spark, d).filter("doc_id % 50 = 0").select("path"))
    )


@query
def merge_roots(spark, d):
    out = roots.merge_roots(
        _src(spark, d), _some_roots(spark, d), excludes=["src1", "de", "/src2/en/*0.txt"]
    )
    return out.select("path", "size")


@query
def select_file_list(spark, d):
    doc = F.col("doc_id")
    path = F.concat_ws("/", F.lit(""), "source", "lang", F.concat(doc, F.lit(".txt")))
    lines = _docs(spark, d).select(
        F.when(doc % 20 == 0, F.concat(path, F.lit("\r")))
        .when(doc % 20 == 1, F.lit("  "))
        .when(doc % 100 == 2, F.concat(F.lit("/missing/"), doc))
        .when(doc % 100 == 3, F.concat(F.lit(" /"), F.concat_ws("/", "source", "lang")))
        .otherwise("")
        .alias("value")
    )
    chosen, missing = roots.select_file_list(_src(spark, d), roots.parse_file_list(lines))
    return chosen.select("path", F.lit("selected").alias("status")).union(
        missing.select("root", F.lit("missing"))
    )


@query
def read_pattern_file(spark, d):
    doc = F.col("doc_id")
    lines = _docs(spark, d).select(
        F.when(doc % 5 == 0, F.concat(F.lit("# "), "source"))
        .when(doc % 5 == 1, F.concat(F.lit("  ;"), "lang"))
        .when(doc % 5 == 2, F.lit("   "))
        .when(doc % 5 == 3, F.concat(F.lit(" \t*."), "lang"))
        .otherwise(F.concat(F.lit("/"), "source", F.lit("/ #"), doc))
        .alias("value")
    )
    return roots.parse_pattern_lines(lines)


@query
def expand_glob_source(spark, d):
    return roots.expand_glob_source(_src(spark, d), "./src1/[d-e]?/*1.txt").select("path", "size")


@query
def rebase_paths(spark, d):
    back = _src(spark, d).withColumn("path", F.translate("path", "/", "\\"))
    return manifest.rebase_paths(back, "data/in").select("path", "size")


@query
def list_only(spark, d):
    return manifest.list_only(samples.tree_manifest(spark, d), excludes=["*1.txt"])


@query
def manifest_summary(spark, d):
    return manifest.manifest_summary(samples.tree_manifest(spark, d))


# --- filters -----------------------------------------------------------------


@query
def glob_filter(spark, d):
    return filters.glob_filter(
        _src(spark, d), ["/src1/en"], ["*1.txt", "src2*/fr/*", "en/1", "?5.txt", "/src3"]
    ).select("path", "size")


@query
def tree_filter(spark, d):
    return filters.tree_filter(_src(spark, d), ["*7.txt"], ["de", "/src3", "*2/fr"]).select("path", "size")


def _scope(spark, d):
    docs = _docs(spark, d)
    return docs.filter("lang in ('en', 'fr')").select(F.concat(F.lit("stale\\"), "lang").alias("root")).union(
        docs.filter("source = 'src1'").select("source")
    )


@query
def delete_scope_filter(spark, d):
    return deletes.delete_scope_filter(_dst(spark, d).select("path", "size"), _scope(spark, d))


@query
def protect_from_delete(spark, d):
    gone = deletes.plan_delete(_src(spark, d), _dst(spark, d))
    skipped = _docs(spark, d).filter("lang = 'de'").select(F.concat(F.lit("stale/"), "lang").alias("path")).distinct()
    return deletes.protect_from_delete(gone, skipped, excludes=["*50.txt"]).select("path", "kind")


@query
def quarantine_unsafe_paths(spark, d):
    doc = F.col("doc_id")
    odd = (
        F.when(doc % 7 == 0, "")
        .when(doc % 7 == 1, F.concat(F.lit("/"), "source"))
        .when(doc % 7 == 2, F.concat("source", F.lit("/../"), "lang"))
        .when(doc % 7 == 3, F.concat("source", F.lit(".."), "lang"))
        .when(doc % 7 == 4, F.concat(F.lit("C:\\"), "source"))
        .when(doc % 7 == 5, F.concat("source", F.lit("\\..")))
        .otherwise(F.concat_ws("/", F.lit("."), "source", "lang"))
    )
    entries = _docs(spark, d).select("doc_id", odd.alias("path"))
    safe, held = filters.quarantine_unsafe_paths(entries)
    return held.unionByName(safe, allowMissingColumns=True).select(
        "doc_id", "path", F.coalesce("unsafe", F.lit("ok")).alias("unsafe")
    )


@query
def syncworthy_events(spark, d):
    return filters.syncworthy_events(samples.events(spark, d), ["view"]).select(
        "event_id", "user_id", "event_type"
    )


# --- planning ----------------------------------------------------------------


@query
def plan_sync(spark, d):
    return planner.plan_sync(_src(spark, d), _dst(spark, d), delete=True).select(
        "path", "kind", "action", "reason", "source_size", "content_matched"
    )


def _plan(spark, d, fn, **flags):
    return fn(_src(spark, d), _dst(spark, d), **flags).select("path", "action", "reason")


@query
def plan_checksum(spark, d):
    return _plan(spark, d, planner.plan_checksum)


@query
def plan_size_only(spark, d):
    return _plan(spark, d, planner.plan_size_only)


@query
def plan_update_only(spark, d):
    return _plan(spark, d, planner.plan_update_only)


@query
def plan_ignore_existing(spark, d):
    return _plan(spark, d, planner.plan_ignore_existing)


@query
def plan_existing(spark, d):
    return _plan(spark, d, planner.plan_existing)


@query
def plan_ignore_times(spark, d):
    return _plan(spark, d, planner.plan_ignore_times, update_only=True)


@query
def plan_meta_only(spark, d):
    return _plan(spark, d, planner.plan_meta_only, checksum=True)


@query
def plan_delete(spark, d):
    return deletes.plan_delete(_src(spark, d), _dst(spark, d), _scope(spark, d)).select("path", "kind")


def _links_and_specials(spark, d):
    page = F.col("page_id")
    base = samples.link_inventory(spark, d)
    src = base.select(
        "path",
        F.when(page % 4 == 3, "fifo").when(page % 4 == 2, "char").otherwise("symlink").alias("kind"),
        F.lit(0).cast("bigint").alias("size"),
        (page + 100).alias("mtime_sec"),
        F.lit(0).alias("mtime_nsec"),
        F.when(page % 4 < 2, F.col("link_target")).alias("link_target"),
        F.when(page % 4 == 2, page % 3).alias("rdev"),
    )
    dst = base.select(
        "path",
        F.when(page % 4 == 3, F.when(page % 16 == 3, "socket").otherwise("fifo"))
        .when(page % 4 == 2, "char")
        .when(page % 8 == 0, "file")
        .otherwise("symlink")
        .alias("kind"),
        F.lit(0).cast("bigint").alias("size"),
        (page + 100 + F.when(page % 7 == 0, 1).otherwise(0)).alias("mtime_sec"),
        F.lit(0).alias("mtime_nsec"),
        F.when(
            (page % 4 < 2) & (page % 8 != 0),
            F.concat("link_target", F.when(page % 3 == 0, "x").otherwise("")),
        ).alias("link_target"),
        F.when(page % 4 == 2, F.when(page % 5 == 0, 9).otherwise(page % 3)).cast("bigint").alias("rdev"),
    )
    return src, dst


@query
def plan_links_specials(spark, d):
    src, dst = _links_and_specials(spark, d)
    return planner.plan_sync(src, dst).select("path", "kind", "action", "reason")


@query
def assign_hardlinks(spark, d):
    src = samples.with_content_inode(_src(spark, d))
    return planner.assign_hardlinks(src, _dst(spark, d)).select("path", "action", "link_to")


@query
def max_delete_guard(spark, d):
    gone = deletes.plan_delete(_src(spark, d), _dst(spark, d))
    return deletes.delete_guard(gone, 30)


def _tree_deletes(spark, d):
    """Deletes on the directory tree: everything stale, and the third languages of some sources."""
    tree = samples.tree_manifest(spark, d)
    gone = F.col("path").startswith("stale/") | F.col("path").rlike(r"\Asrc[1-3]/fr(/|\z)")
    return tree, tree.filter(gone | (F.col("path") == "stale")).select("path", "kind")


@query
def delete_order(spark, d):
    _, gone = _tree_deletes(spark, d)
    return deletes.delete_order(gone).select("path", "kind", "phase", "depth")


@query
def prune_empty_dirs(spark, d):
    tree, gone = _tree_deletes(spark, d)
    return deletes.prune_empty_dirs(tree, gone.filter("kind = 'file'"))


@query
def table_diff(spark, d):
    orders = samples.table(spark, d, "orders")
    price = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    status = F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))
    newer = orders.filter("o_orderkey % 10 <> 0").select(
        "o_orderkey", price.alias("o_totalprice"), status.alias("o_orderstatus"), "o_custkey"
    )
    older = orders.filter("o_orderkey % 13 <> 0")
    out = diff.table_diff(newer, older, ["o_orderkey"], ["o_totalprice", "o_orderstatus", "o_custkey"])
    return out.select("o_orderkey", "action", F.array_join("changed", ",").alias("changed"))


@query
def cross_basis_pairs(spark, d):
    plan = planner.plan_sync(_src(spark, d), _dst(spark, d), checksum=True)
    return pairing.cross_basis_pairs(plan, min_size=64)


@query
def reprobe_after_apply(spark, d):
    src, dst = _src(spark, d), _dst(spark, d)
    return diff.reprobe_after_apply(src, dst).select("path", "size", "now_size")


# --- signatures, delta, patch ------------------------------------------------


@query
def fixed_block_signature(spark, d):
    return signatures.fixed_block_signature(_contents(spark, d)).select("path", "idx", "offset", "len", "strong")


@query
def weak_checksum(spark, d):
    return signatures.fixed_block_signature(_contents(spark, d), block=256, weak=True).select(
        "path", "idx", "weak"
    )


@query
def cdc_chunks(spark, d):
    return signatures.cdc_chunks(_contents(spark, d), min_size=256, avg_size=1024, max_size=4096)


@query
def cdc_chunks_tile(spark, d):
    """Put the content-defined chunks back together: they must give each document."""
    docs = _contents(spark, d)
    chunks = signatures.cdc_chunks(docs, min_size=256, avg_size=1024, max_size=4096)
    spans = chunks.groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("idx", "offset", "len", "strong"))).alias("spans"),
        F.max("len").alias("longest"),
    )
    data = docs.select("path", F.col("content").cast("binary").alias("data"))
    piece = lambda c: F.substring("data", (c["offset"] + 1).cast("int"), c["len"])
    return spans.join(data, "path").select(
        "path",
        F.sha2(F.unhex(F.array_join(F.transform("spans", lambda c: F.hex(piece(c))), "")), 256).alias("hash"),
        F.forall("spans", lambda c: F.sha2(piece(c), 256) == c["strong"]).alias("hashes_agree"),
        (F.col("longest") <= 4096).alias("bounded"),
    )


@query
def text_cdc_segments(spark, d):
    return signatures.text_cdc_segments(_contents(spark, d), "content", keep=["doc_id"])


@query
def signature_index(spark, d):
    return signatures.signature_index(signatures.fixed_block_signature(_contents(spark, d), block=BLOCK))


def _block_ops(spark, d):
    source, basis = samples.delta_pair(spark, d)
    return delta.compute_delta(
        signatures.fixed_block_signature(source, block=BLOCK),
        signatures.fixed_block_signature(basis, block=BLOCK),
    )


@query
def compute_delta(spark, d):
    return _block_ops(spark, d)


@query
def coalesce_ops(spark, d):
    return delta.coalesce_ops(_block_ops(spark, d))


@query
def delta_stats(spark, d):
    return delta.delta_stats(delta.coalesce_ops(_block_ops(spark, d)))


@query
def delta_fallback(spark, d):
    source, basis = samples.delta_pair(spark, d)
    stats = delta.delta_stats(_block_ops(spark, d))
    heads = delta.delta_heads(source, basis)
    return delta.delta_fallback(stats, heads, budget=2000, cross_basis=True)


@query
def validate_ops(spark, d):
    source, basis = samples.delta_pair(spark, d)
    stale = basis.withColumn("content", F.substring("content", 1, 400))
    return delta.validate_ops(delta.coalesce_ops(_block_ops(spark, d)), delta.delta_heads(source, stale))


def _rebuilt(spark, d, emptied=False):
    source, basis = samples.delta_pair(spark, d)
    if emptied:
        source, basis = samples.with_emptied(source, basis)
    return delta.apply_patch(basis, delta.delta_between(source, basis, BLOCK), heads=source)


@query
def apply_patch(spark, d):
    return _rebuilt(spark, d, emptied=True).select("path", F.col("content").cast("string").alias("content"))


@query
def verify_reconstruction(spark, d):
    source, basis = samples.delta_pair(spark, d)
    wanted = source.withColumn(
        "content", F.when(F.col("hash").startswith("0"), F.reverse("content")).otherwise(F.col("content"))
    )
    return delta.verify_reconstruction(_rebuilt(spark, d), delta.delta_heads(wanted, basis))


@query
def sliding_match(spark, d):
    source, basis = samples.delta_pair(spark, d)
    return delta.sliding_match(source, basis).drop("literal")


@query
def sliding_match_rebuild(spark, d):
    """Apply the deltas found at any offset: the result must be the source."""
    source, basis = samples.delta_pair(spark, d)
    rebuilt = delta.apply_patch(basis, delta.delta_between(source, basis), heads=source)
    return rebuilt.select("path", F.sha2(F.col("content"), 256).alias("hash"))


BLOB_PIECE = 4096


@query
def blob_chunks(spark, d):
    """Content-defined chunks of documents held as pieces, summed up per document."""
    pieces = blobs.to_pieces(_contents(spark, d), size=BLOB_PIECE)
    chunks = blobs.cdc_chunks_of_pieces(pieces, 256, 1024, 4096, size=BLOB_PIECE)
    return chunks.groupBy("path").agg(F.sum("len").alias("bytes"), (F.max("len") <= 4096).alias("bounded"))


@query
def blob_patch(spark, d):
    """Changed documents as pieces, matched at any offset, patched in pieces, and read back."""
    source, basis = samples.with_emptied(*samples.delta_pair(spark, d))
    after, before = blobs.to_pieces(source, size=BLOB_PIECE), blobs.to_pieces(basis, size=BLOB_PIECE)
    ops = blobs.sliding_ops(after, signatures.fixed_block_signature(basis, weak=True), longest=BLOB_PIECE)
    full = checkpointed(blobs.literal_pieces(ops, after, BLOB_PIECE))
    built = blobs.patch_pieces(before, full, delta.delta_heads(source, basis), BLOB_PIECE)
    return blobs.from_pieces(built).select("path", F.sha2("content", 256).alias("hash"))


@query
def chunk_dedup_report(spark, d):
    segments = signatures.text_cdc_segments(_contents(spark, d), "content", keep=["source"])
    return signatures.chunk_dedup_report(segments)


@query
def signature_cache(spark, d):
    dst = _dst(spark, d)
    entries = cache.signature_cache_entries(dst, signatures.fixed_block_signature(dst), "fixed")
    hits, misses = cache.signature_cache(_src(spark, d), entries, "fixed")
    counted = hits.groupBy("path").agg(F.count("*").alias("chunks"))
    return counted.select("path", F.lit("hit").alias("status"), "chunks").union(
        misses.select("path", F.lit("miss"), F.lit(0).cast("bigint"))
    )


# --- tiers -------------------------------------------------------------------


@query
def classify_size(spark, d):
    return _src(spark, d).select("path", tiers.classify_size(F.col("size"), 1000, 5000).alias("size_class"))


@query
def choose_strategy(spark, d):
    dst = _dst(spark, d).select("path", F.lit(True).alias("there"))
    joined = _src(spark, d).select("path", "size").join(dst, "path", "left")
    there = F.coalesce("there", F.lit(False))
    return joined.select("path", tiers.choose_strategy(F.col("size"), there, 2000).alias("strategy"))


@query
def pack_batches(spark, d):
    return tiers.pack_batches(_src(spark, d), 1 << 16)


# --- reports -----------------------------------------------------------------


@query
def plan_counts(spark, d):
    return reports.plan_counts(planner.plan_sync(_src(spark, d), _dst(spark, d), delete=True))


@query
def itemize(spark, d):
    return reports.itemize(planner.plan_sync(_src(spark, d), _dst(spark, d), delete=True))


def _skips(spark, d):
    doc = F.col("doc_id")
    return _src(spark, d).filter(doc % 17 == 0).select(
        "path", F.when(doc % 2 == 0, "locked").otherwise("path too long").alias("reason")
    )


@query
def sync_stats(spark, d):
    return reports.sync_stats(planner.plan_sync(_src(spark, d), _dst(spark, d)), _skips(spark, d))


@query
def skip_report(spark, d):
    return reports.skip_report(_skips(spark, d))


def _received(spark, d):
    return _dst(spark, d).filter("doc_id % 9 <> 0").select("path", "hash")


@query
def verify_report(spark, d):
    return reports.verify_report(_src(spark, d), _received(spark, d), _skips(spark, d))


@query
def transfer_rate(spark, d):
    return reports.transfer_rate(samples.progress_feed(spark, d))


@query
def bench_summary(spark, d):
    runs = samples.events(spark, d).select(
        F.col("event_type").alias("tool"),
        (F.col("user_id") % 4).alias("scenario"),
        F.col("value").alias("seconds"),
        (F.col("event_id") % 3).alias("rc"),
    )
    return reports.bench_summary(runs)


# --- links and permissions ---------------------------------------------------


def _classified(spark, d):
    tree = samples.link_tree(spark, d)
    return links.classify_links(tree.filter("kind = 'symlink'"), samples.external_tree(spark, d), entries=tree)


@query
def classify_links(spark, d):
    return _classified(spark, d).select("path", "link_target", "final", "target_kind", "link_class")


@query
def rewrite_internal_links(spark, d):
    return links.rewrite_internal_links(_classified(spark, d)).select("path", "rewritten")


@query
def followed_entries(spark, d):
    return link_targets.followed_entries(samples.link_tree(spark, d), samples.external_tree(spark, d))


@query
def link_policy(spark, d):
    policies = {
        "default": links.LinkPolicy(),
        "literal-dirs": links.LinkPolicy(literal_external_dir=True, literal_internal=True),
        "follow": links.LinkPolicy(follow=True, literal=True),
        "skip": links.LinkPolicy(skip=True, follow=True),
    }
    classified, out = _classified(spark, d), None
    for name, policy in policies.items():
        part = links.link_policy(classified, policy).withColumn("policy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query
def detect_link_cycles(spark, d):
    return links.detect_link_cycles(samples.link_tree(spark, d).filter("kind = 'symlink'"))


@query
def final_mode(spark, d):
    files = _src(spark, d).withColumn(
        "path", F.concat("path", F.when(F.col("doc_id") % 3 == 0, ".PY").otherwise(""))
    )
    runs = {
        "unix": {}, "archive": {"archive": True}, "no-perms": {"no_perms": True},
        "windows": {"source_os": "windows"},
    }
    out = None
    for name, kw in runs.items():
        part = links.final_mode(files, **kw).select("path", "mode", F.lit(name).alias("run"))
        out = part if out is None else out.unionByName(part)
    return out


# --- streaming ---------------------------------------------------------------

DELAY, CAP = 6 * 3600, 12 * 3600


def _wall_clock(df):
    """Times as the event table stores them, without a zone."""
    for c in ("burst_start", "last_event"):
        df = df.withColumn(c, samples.as_wall_clock(F.col(c)))
    return df


@query
def debounce_bursts(spark, d):
    return _wall_clock(bursts.debounce_bursts(samples.events(spark, d), "user_id", DELAY))


@query
def debounce_capped(spark, d):
    return _wall_clock(bursts.debounce_capped(samples.events(spark, d), "user_id", DELAY, CAP))


@query
def debounce_stream(spark, d):
    """Plain bursts by the streaming form, read out whole."""
    raw = samples.stream_table(spark, d, "events").withColumn("ts", samples.as_instant(F.col("ts")))
    place = scratch_path(spark, "bursts")
    running = (
        bursts.debounce_stream(raw, "user_id", f"{DELAY} seconds", "60 days").writeStream.outputMode("complete")
        .option("checkpointLocation", f"{place}/checkpoint")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{place}/table"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return _wall_clock(spark.read.parquet(f"{place}/table"))


@query
def debounce_capped_stream(spark, d):
    """Capped bursts by the streaming form, from files that each hold a part of every key's time, in no order."""
    place = scratch_path(spark, "capped")
    events = samples.events(spark, d).select("user_id", "ts")
    # The last two files only let the watermark pass all others.
    latest = events.agg(F.max("ts").alias("ts"))
    ends = [latest.select(F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), F.timestamp_add("YEAR", F.lit(n), "ts").alias("ts")) for n in (1, 2)]
    parts = [events.filter(F.pmod(F.xxhash64("user_id", "ts"), F.lit(3)) == i) for i in range(3)]
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in [*parts, *ends]:
            part.write.mode("append").parquet(f"{place}/events")
            raw = spark.readStream.schema(events.schema).parquet(f"{place}/events")
            bursts.debounce_capped_stream(raw, "user_id", DELAY, CAP, "60 days").writeStream.outputMode("append").option(
                "checkpointLocation", f"{place}/checkpoint"
            ).trigger(availableNow=True).format("parquet").start(f"{place}/table").awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    return _wall_clock(spark.read.parquet(f"{place}/table").filter("user_id <> -1"))


def _change_stream(spark, d):
    """The documents as a stream of changes: every tenth document is deleted, others are upserts."""
    raw = samples.stream_table(spark, d, "documents")
    doc = F.col("doc_id")
    data = F.col("text").cast("binary")
    path = F.concat_ws("/", "source", "lang", F.concat(doc, F.lit(".txt")))
    swap = F.when(doc % 50 == 3, F.array(path, F.concat(F.lit("swap/"), doc))).otherwise(F.array(path))
    return raw.select(
        F.explode(swap).alias("path"),
        F.lit("file").alias("kind"),
        F.octet_length(data).cast("bigint").alias("size"),
        F.lit(420).alias("mode"),
        (doc * 60 + 1700000000).alias("mtime_sec"),
        (doc % 1000).cast("int").alias("mtime_nsec"),
        F.sha2(data, 256).alias("hash"),
        doc.alias("seq"),
        (doc % 10 == 7).alias("deleted"),
    )


def _watched(spark, d, name, **kw):
    place = scratch_path(spark, name)
    _, dst = samples.swapped(_src(spark, d), _dst(spark, d))
    base = dst.filter("not startswith(path, 'emptied/')").select("path", "kind", "size", "mode", "mtime_sec", "mtime_nsec", "hash")
    running = watch.watch_sync(
        _change_stream(spark, d), f"{place}/table", f"{place}/checkpoint", baseline=base,
        **{"available_now": True, "buckets": 16, **kw},
    )
    return running, f"{place}/table"


@query
def watch_sync(spark, d):
    running, table = _watched(spark, d, "watch")
    running.awaitTermination()
    return watch.read_synced(spark, table)


@query
def retry_cycle(spark, d):
    failures = []

    def flaky(batch, location, tag):
        watch.apply_changes(batch, location, tag)
        if not failures:
            failures.append(location)
            raise ConnectionError("lost after the write")

    running, table = _watched(spark, d, "retry", backoff=0.1, apply=flaky)
    running.awaitTermination()
    return watch.read_synced(spark, table)


@query
def bounded_watch(spark, d):
    """A watch that would go on for ever, stopped when nothing has come for a while."""
    running, table = _watched(spark, d, "bounded", available_now=False, processing_time="1 second")
    watch.bounded_watch(running, "10m", idle="3s")
    return watch.read_synced(spark, table)


@query
def watch_totals(spark, d):
    """Totals of three files of events, a batch each."""
    place = scratch_path(spark, "totals")
    cycles = samples.table(spark, d, "events").select(
        F.col("event_type").alias("action"), (F.col("value") * 100).cast("bigint").alias("source_size")
    )
    cycles.repartition(3).write.parquet(f"{place}/cycles")
    raw = spark.readStream.schema(cycles.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/cycles")
    watch.keep_totals(raw, f"{place}/table", f"{place}/checkpoint").awaitTermination()
    return watch.read_totals(spark, f"{place}/table")


# --- apply -------------------------------------------------------------------


@query
def apply_plan(spark, d):
    src, dst = samples.swapped(_src(spark, d), _dst(spark, d))
    plan = planner.plan_sync(src, dst, delete=True)
    return apply.apply_plan(plan, src, dst).select("path", "size", "mode", "mtime_sec", "mtime_nsec", "hash")


def _synced(spark, d):
    """A run with deletes, deltas and pairs of siblings against the published older snapshot."""
    src, dst = samples.swapped(_src(spark, d), _dst(spark, d))
    place = scratch_path(spark, "run")
    apply.publish_snapshot(dst.drop("doc_id"), place)
    options = run.SyncOptions(delete=True, delta=True, delta_min=1000, pair_min=500)
    return run.sync_table(src.drop("doc_id"), place, options), place


@query
def sync_run(spark, d):
    _, place = _synced(spark, d)
    return watch.read_synced(spark, place).select("path", "size", "mode", "mtime_sec", "mtime_nsec", "hash")


@query
def publish_snapshot(spark, d):
    place = scratch_path(spark, "publish")
    apply.publish_snapshot(_dst(spark, d), place)
    apply.publish_snapshot(_src(spark, d).select("path", "size", "hash"), place, compression="lz4")
    return apply.read_snapshot(spark, place)


@query
def backup_replaced(spark, d):
    src, dst = samples.swapped(_src(spark, d), _dst(spark, d))
    plan = checkpointed(planner.plan_sync(src, dst, delete=True))
    cols = ["path", "size", "hash"]
    older = _dst(spark, d).filter("doc_id % 10 = 1").withColumn("path", F.concat("path", F.lit("~")))
    backups = apply.backup_replaced(plan, dst).select(*cols)
    after = apply.apply_plan(plan, src, dst).select(*cols).unionByName(older.select("path", F.lit(0).cast("bigint").alias("size"), "hash"))
    return apply.with_backups(after, backups)


@query
def resumed_run(spark, d):
    """A run that ends after some of its groups of buckets, and the run after it."""
    src, dst = samples.swapped(_src(spark, d), _dst(spark, d))
    place, groups = scratch_path(spark, "resumed"), 4
    apply.publish_snapshot(dst.drop("doc_id"), place, buckets=16)
    plan = checkpointed(planner.plan_sync(src, dst, delete=True))
    half = plan.filter(apply.bucket_of(F.col("path"), groups) < 2)
    run.append_plan(half, src.drop("doc_id"), watch.read_synced(spark, place), None, place, run.SyncOptions(groups=2))
    left = apply.resume_apply(plan, watch.applied_ledger(spark, place, ""))
    run.append_plan(left, src.drop("doc_id"), watch.read_synced(spark, place), None, place, run.SyncOptions())
    return watch.read_synced(spark, place).select("path", "size", "mode", "mtime_sec", "mtime_nsec", "hash")


@query
def retire_verified_sources(spark, d):
    doc = F.col("doc_id")
    scanned = _src(spark, d).withColumn("dereferenced", doc % 13 == 0)
    current = scanned.withColumn("mtime_sec", F.col("mtime_sec") + F.when(doc % 11 == 0, 1).otherwise(0))
    transferred = scanned.filter("doc_id % 3 <> 0").select("path", "hash")
    return apply.retire_verified_sources(
        scanned, current, transferred, _received(spark, d), _skips(spark, d)
    ).select("path", "size")


@query
def resume_apply(spark, d):
    plan = planner.plan_sync(_src(spark, d), _dst(spark, d), delete=True)
    ledger = _src(spark, d).filter("doc_id % 4 = 0").select("path", F.lit("update").alias("action")).union(
        _src(spark, d).filter("doc_id % 40 = 0").select("path", F.lit("create"))
    )
    return apply.resume_apply(plan, ledger).select("path", "action")
