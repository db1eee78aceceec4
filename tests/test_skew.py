"""Joins with a key that holds a third of all rows."""

from pyspark.sql import functions as F

from sparksync.functions.skew import hot_keys, lookup_join


def test_hot_keys_are_bounded(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    assert [r["k"] for r in hot_keys(df, "k", min_rows=10).collect()] == [-1]
    assert hot_keys(df, "k", most=5, min_rows=1).count() == 5


def test_lookup_join_equals_plain_join(spark):
    left = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"),
    )
    right = spark.range(-1, 2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(left, "k", min_rows=100)
    for how in ("left", "inner"):
        got = lookup_join(left, right, "k", spread="id", how=how, fan=8, hot=hot)
        want = left.join(right, "k", how)
        assert got.select("id", "k", "v").exceptAll(want.select("id", "k", "v")).isEmpty()
        assert got.count() == want.count()


def test_hot_key_is_spread(spark):
    left = spark.range(4000).select("id", F.lit(1).cast("long").alias("k"))
    right = spark.createDataFrame([(1, "x")], "k long, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = lookup_join(left, right, "k", spread="id", fan=64, hot=hot_keys(left, "k", min_rows=10))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 2500
