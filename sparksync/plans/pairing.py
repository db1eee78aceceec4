"""Find a similar sibling to serve as delta basis for a file that has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparksync.functions import paths
from sparksync.functions.binding import let
from sparksync.functions.skew import lookup_join

PAIR_MIN_BYTES = 1 << 20
DELTA_MIN_BYTES = 10 << 20


def cross_basis_pairs(plan: DataFrame, min_size: int = PAIR_MIN_BYTES, delta_min: int = DELTA_MIN_BYTES) -> DataFrame:
    """Pair whole-file transfers with an earlier sibling of the plan.

    A sibling shares the parent directory and the extension, one stem is a
    proper prefix of the other, and sizes are within 2x. Plan order is creates
    before updates, each by path. The closest size wins; ties prefer prefix
    stems by growing length, then longer stems in plan order. Updates above
    ``delta_min`` have their own old version and look for none.

    Every entry is exploded into its proper stem prefixes and equi-joined with
    the one entry that can own such a stem (a directory holds one file per
    stem and extension), so the work is entries x stem length and never a
    pair per sibling pair.
    """
    size = F.col("source_size")
    entries = plan.filter(
        (F.col("kind") == "file")
        & F.col("action").isin("create", "update")
        & (size >= F.ceil(F.lit(min_size) / 2))
    )
    if "link_to" in plan.columns:
        entries = entries.filter(F.col("link_to").isNull())
    keyed = entries.select(
        "path",
        F.col("source_size").alias("size"),
        F.struct(F.when(F.col("action") == "create", 0).otherwise(1).alias("phase"), "path").alias("pos"),
        # Only whole-file transfers look for a basis.
        ((size >= min_size) & ((F.col("action") == "create") | (size <= delta_min))).alias("wants"),
        # Null marks "no extension", which differs from an empty one.
        F.to_json(F.struct(paths.parent(F.col("path")).alias("p"), paths.extension(F.col("path")).alias("e"))).alias("dir"),
        paths.stem(F.col("path")).alias("stem"),
    )
    named = lambda prefix, df: df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("path", "size", "pos", "wants")], "key")
    owner = named("short", keyed.withColumn("key", F.concat_ws("\x00", "dir", "stem")))
    n = F.char_length("stem")
    prefixes = let(
        F.col("stem"),
        lambda stem: F.transform(
            F.sequence(F.lit(1), F.greatest(F.char_length(stem) - 1, F.lit(1))),
            lambda i: F.substring(stem, F.lit(1), i),
        ),
    )
    longer = named(
        "long",
        keyed.filter(n > 1)
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("key", F.concat_ws("\x00", "dir", "prefix")),
    )
    close = F.greatest("long_size", "short_size") <= 2 * F.least("long_size", "short_size")
    pairs = lookup_join(longer, owner, "key", spread="long_path", how="inner").filter(close)

    diff = F.abs(F.col("long_size") - F.col("short_size"))
    as_long = pairs.filter(F.col("long_wants") & (F.col("short_pos") < F.col("long_pos"))).select(
        F.col("long_path").alias("path"),
        F.struct(
            diff.alias("diff"),
            F.lit(0).alias("side"),
            F.char_length("key").alias("len"),
            F.col("short_pos").alias("pos"),
            F.col("short_size").alias("basis_size"),
        ).alias("cand"),
    )
    as_short = pairs.filter(F.col("short_wants") & (F.col("long_pos") < F.col("short_pos"))).select(
        F.col("short_path").alias("path"),
        F.struct(
            diff.alias("diff"),
            F.lit(1).alias("side"),
            F.lit(0).alias("len"),
            F.col("long_pos").alias("pos"),
            F.col("long_size").alias("basis_size"),
        ).alias("cand"),
    )
    best = as_long.unionByName(as_short).groupBy("path").agg(F.min("cand").alias("cand"))
    return best.select(
        "path", F.col("cand.pos.path").alias("basis_path"), F.col("cand.basis_size").alias("basis_size")
    )
