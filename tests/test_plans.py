"""Physical plans: no products, no nested loops, no window over everything."""

import pytest

from sparksync.queries import REGISTRY

STREAMING = {"watch_sync", "retry_cycle", "bounded_watch", "watch_totals", "debounce_stream", "debounce_capped_stream"}


@pytest.fixture(scope="module")
def plans(spark, sf):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    # Filters that Spark adds by itself, one row per task.
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "false")
    try:
        yield {
            name: fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
            for name, fn in REGISTRY.items()
            if name not in STREAMING
        }
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.optimizer.runtime.bloomFilter.enabled")


def test_no_products(plans):
    bad = {n for n, p in plans.items() if "CartesianProduct" in p or "NestedLoopJoin" in p}
    assert not bad


def test_single_partition_only_for_small_results(plans):
    """One task may only see one row per task or per partition: global counts and batch offsets."""
    single = {n for n, p in plans.items() if "SinglePartition" in p}
    assert single <= {"max_delete_guard", "sync_stats", "pack_batches"}


def test_broadcasts_are_bounded(plans):
    """With Spark's own broadcasts off, only hot keys and batch offsets are broadcast."""
    cast = {n for n, p in plans.items() if "BroadcastExchange" in p}
    assert cast <= {"assign_hardlinks", "classify_links", "link_policy", "rewrite_internal_links", "cross_basis_pairs", "pack_batches"}
    for name in cast - {"pack_batches"}:
        assert "TakeOrderedAndProject" in plans[name]


def test_python_only_where_needed(plans):
    python = {n for n, p in plans.items() if "Python" in p or "MapInPandas" in p or "ArrowEval" in p}
    assert python <= {
        "weak_checksum", "cdc_chunks", "cdc_chunks_tile", "sliding_match", "sliding_match_rebuild", "apply_patch", "verify_reconstruction",
        "blob_chunks", "blob_patch",
    }
