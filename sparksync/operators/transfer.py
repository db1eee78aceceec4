"""Content of changed rows by delta where that is worth it, with bases that may be made in the same run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparksync.functions.content import strong_hash
from sparksync.operators.delta import LITERAL_BUDGET, apply_patch, delta_fallback, delta_heads, delta_stats, sliding_match
from sparksync.operators.tiers import DELTA_MIN, choose_strategy
from sparksync.plans.pairing import PAIR_MIN_BYTES, cross_basis_pairs
from sparksync.session import checkpointed


def transfer_contents(
    plan: DataFrame, src: DataFrame, dst: DataFrame, delta_min: int = DELTA_MIN, pair_min: int = PAIR_MIN_BYTES, budget: int = LITERAL_BUDGET, content: str = "content"
) -> DataFrame:
    """(path, content, how, basis_path, reason, bytes_matched, bytes_literal) of the files that ``plan`` creates or updates.

    ``how`` is copy or delta. An updated file above ``delta_min`` takes its old
    version as basis. Other files take a similar sibling of this run, which may
    itself be made from a sibling: such rows wait until their basis is there,
    one round per link of the longest chain. A delta that does not pay, or
    does not give the source's hash, becomes a copy with a ``reason``.
    """
    files = plan.filter((F.col("kind") == "file") & F.col("action").isin("create", "update"))
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    there = F.col("action") == "update"
    large = files.filter(choose_strategy(F.col("source_size"), there, delta_min) == "delta").select("path")
    # All content of a side is shuffled once, for the rows that are needed; the steps below read only these.
    old = checkpointed(dst.join(large, "path", "left_semi").select("path", data.alias("content")).filter(F.octet_length("content") > 0))
    own = large.join(old.select("path"), "path", "left_semi").distinct()
    marked = files.select("path").distinct().join(own.withColumn("own", F.lit(True)), "path", "left")
    wanted = checkpointed(src.join(marked, "path").select("path", data.alias("content"), F.coalesce("own", F.lit(False)).alias("own")))
    with_old, wanted = (wanted.filter(f"own = {flag}").drop("own") for flag in ("true", "false"))
    pairs = checkpointed(cross_basis_pairs(plan, pair_min, delta_min).select("path", "basis_path").join(own, "path", "left_anti"))
    plain = wanted.join(pairs, "path", "left_anti")
    first = _by_delta(with_old, old, budget, cross=False).withColumn("basis_path", F.col("path"))
    done = checkpointed(first.unionByName(_copied(plain, None)))
    made, rest = [done], pairs
    while not rest.isEmpty():
        ready = rest.join(done.select(F.col("path").alias("basis_path"), F.col("content").alias("basis")), "basis_path")
        ready = checkpointed(ready)
        if ready.isEmpty():  # a basis that the source does not hold
            made.append(_copied(wanted.join(rest, "path", "left_semi"), "no-basis"))
            break
        basis = ready.select("path", F.col("basis").alias("content"))
        due = checkpointed(wanted.join(ready.select("path"), "path", "left_semi"))
        level = _by_delta(due, basis, budget, cross=True)
        done = checkpointed(level.join(ready.select("path", "basis_path"), "path"))
        made.append(done)
        rest = checkpointed(rest.join(ready.select("path"), "path", "left_anti"))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.withColumn("basis_path", F.when(F.col("how") == "delta", F.col("basis_path"))).select(
        "path", F.col("content").cast(src.schema[content].dataType).alias(content), "how", "basis_path", "reason", "bytes_matched", "bytes_literal"
    )


def _copied(rows: DataFrame, reason: str | None) -> DataFrame:
    return rows.select(
        "path", "content", F.lit("copy").alias("how"), F.lit(reason).cast("string").alias("reason"), F.lit(0).cast("long").alias("bytes_matched"),
        F.octet_length("content").cast("long").alias("bytes_literal"), F.lit(None).cast("string").alias("basis_path"),
    )


def _by_delta(source: DataFrame, basis: DataFrame, budget: int, cross: bool) -> DataFrame:
    ops = checkpointed(sliding_match(source, basis))
    stats = delta_stats(ops)
    verdict = delta_fallback(stats, delta_heads(source, basis), budget, cross_basis=cross).join(stats, "path", "left")
    chosen = verdict.filter("transfer = 'delta'").select("path")
    built = apply_patch(basis, ops.join(chosen, "path", "left_semi"), chosen).withColumnRenamed("content", "built")
    rows = source.join(verdict, "path").join(built, "path", "left")
    good = F.coalesce(strong_hash(F.col("built")) == strong_hash(F.col("content")), F.lit(False))
    size = F.octet_length("content").cast("long")
    return rows.select(
        "path",
        F.when(good, F.col("built")).otherwise(F.col("content")).alias("content"),
        F.when(good, "delta").otherwise("copy").alias("how"),
        F.when(good, None).otherwise(F.coalesce("fallback_reason", F.lit("hash"))).alias("reason"),
        F.when(good, F.coalesce("bytes_matched", F.lit(0))).otherwise(0).cast("long").alias("bytes_matched"),
        F.when(good, F.coalesce("bytes_literal", F.lit(0))).otherwise(size).cast("long").alias("bytes_literal"),
    )
