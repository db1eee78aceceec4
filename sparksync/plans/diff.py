"""Diff of any two keyed tables, and the check after an apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def table_diff(src: DataFrame, dst: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Action per key plus the names of the columns that changed.

    Keys must be unique on each side; only key and compared columns are shuffled.
    """
    left = src.select(*key, *[F.col(c).alias(f"_s_{c}") for c in cols], F.lit(True).alias("_in_src"))
    right = dst.select(*key, *[F.col(c).alias(f"_d_{c}") for c in cols], F.lit(True).alias("_in_dst"))
    changed = F.filter(
        F.array(*[F.when(~F.col(f"_s_{c}").eqNullSafe(F.col(f"_d_{c}")), F.lit(c)) for c in cols]),
        lambda name: name.isNotNull(),
    )
    both = F.col("_in_src").isNotNull() & F.col("_in_dst").isNotNull()
    action = (
        F.when(F.col("_in_dst").isNull(), "create")
        .when(F.col("_in_src").isNull(), "delete")
        .when(F.size("changed") > 0, "update")
        .otherwise("skip")
    )
    return (
        left.join(right, key, "full_outer")
        .withColumn("changed", F.when(both, changed).otherwise(F.array().cast("array<string>")))
        .withColumn("action", action)
        .select(*key, "action", "changed")
    )


def reprobe_after_apply(applied: DataFrame, fresh: DataFrame) -> DataFrame:
    """Applied entries whose destination now differs in size or mtime, or is gone."""
    cols = ["size", "mtime_sec", "mtime_nsec"]
    want = applied.select("path", *cols)
    now = fresh.select("path", *[F.col(c).alias(f"now_{c}") for c in cols])
    still = F.lit(True)
    for c in cols:
        still = still & F.col(c).eqNullSafe(F.col(f"now_{c}"))
    return want.join(now, "path", "left").filter(~still)
