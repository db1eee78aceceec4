"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sparksync.queries import REGISTRY
from sparksync.session import local_session

HEADLINE = [
    "plan_sync",
    "plan_checksum",
    "plan_counts",
    "assign_hardlinks",
    "table_diff",
    "fixed_block_signature",
    "weak_checksum",
    "cdc_chunks",
    "text_cdc_segments",
    "compute_delta",
    "coalesce_ops",
    "sliding_match",
    "apply_patch",
    "chunk_dedup_report",
    "signature_cache",
    "pack_batches",
    "debounce_bursts",
    "debounce_capped",
    "transfer_rate",
    "apply_plan",
    "publish_snapshot",
    "watch_sync",
    "cross_basis_pairs",
    "detect_link_cycles",
    "signature_index",
    "backup_replaced",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    # Start the session and the Python workers outside the measured time.
    REGISTRY["list_only"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    REGISTRY["cdc_chunks_tile"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
