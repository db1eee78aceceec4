"""Size classes, transfer strategy, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparksync.session import checkpointed

SMALL_MAX = 2 << 20
MEDIUM_MAX = 16 << 20
DELTA_MIN = 10 << 20
BATCH_BYTES = 128 << 20


def classify_size(size: Column, small_max: int = SMALL_MAX, medium_max: int = MEDIUM_MAX) -> Column:
    return F.when(size <= small_max, "small").when(size <= medium_max, "medium").otherwise("large")


def choose_strategy(size: Column, dest_exists: Column, delta_min: int = DELTA_MIN) -> Column:
    return F.when(dest_exists & (size > delta_min), "delta").otherwise("copy")


def pack_batches(rows: DataFrame, budget: int = BATCH_BYTES, parts: int | None = None) -> DataFrame:
    """Number batches of about ``budget`` bytes over all rows in path order.

    The running total is made in two passes: rows are range partitioned by
    path and staged, one small row per partition gives its offset, and the
    running sum continues inside each partition. The staging also pins the
    partition numbers, which a second evaluation could draw differently.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select("path", "size").repartitionByRange(parts, "path")
    staged = checkpointed(ranged.withColumn("_part", F.spark_partition_id()))
    # At most `parts` rows: the offsets fit one task and may be broadcast.
    sums = staged.groupBy("_part").agg(F.sum("size").alias("_sum"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_part").orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("_offset")
    return staged.join(F.broadcast(offsets), "_part").select(
        "path", "size", F.floor(before / budget).cast("bigint").alias("batch")
    )
