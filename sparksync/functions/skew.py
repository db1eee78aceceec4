"""Joins that survive a hot key.

A key that holds a large share of the rows would land in one shuffle
partition. ``lookup_join`` finds such keys with a map-side combined count,
spreads their rows over many partitions, and repeats the one matching row of
the other side there. At most ``HOT_KEYS`` keys are taken, whatever the data
size, so they are safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_KEYS = 10_000
HOT_MIN_ROWS = 100_000


def hot_keys(df: DataFrame, key: str, most: int = HOT_KEYS, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """The ``most`` keys with the most rows, as far as they have ``min_rows``.

    Every key with more than ``1/most`` of all rows is among them, and there
    are never more than ``most``.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return hot_of_counts(counts, key, "_n", most, min_rows)


def hot_of_counts(
    counts: DataFrame,
    key: str,
    n: str,
    most: int = HOT_KEYS,
    min_rows: int = HOT_MIN_ROWS,
    ties: list[str] = (),
) -> DataFrame:
    """``hot_keys`` where the rows per key are already counted.

    ``ties`` names further columns of ``counts`` to order by. Naming all of
    them lets Spark reuse the shuffle that ``counts`` has elsewhere in a query.
    """
    order = [F.desc(n), *ties, key]
    return counts.filter(F.col(n) >= min_rows).orderBy(*order).limit(most).select(key)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: str,
    how: str = "left",
    fan: int = 512,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, whose ``key`` is unique, without a hot partition.

    ``spread`` names a left column with many values; it decides
    deterministically which of the ``fan`` slots a row of a hot key goes to.
    ``hot`` may pass hot keys that are already known.
    """
    hot = (hot_keys(left, key) if hot is None else hot).withColumn("_hot", F.lit(True))
    slot = F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(F.col(spread)), F.lit(fan)).cast("int"))
    spread_left = (
        left.join(F.broadcast(hot), key, "left")
        .withColumn("_slot", F.coalesce(slot, F.lit(0)))
        .drop("_hot")
    )
    slots = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(fan - 1))).otherwise(F.array(F.lit(0)))
    spread_right = (
        right.join(F.broadcast(hot), key, "left")
        .withColumn("_slot", F.explode(slots))
        .drop("_hot")
    )
    return spread_left.join(spread_right, [key, "_slot"], how).drop("_slot")
