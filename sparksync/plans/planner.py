"""Manifest x manifest planning.

One equi-join on path and one decision expression per row. Without deletes
it is a left join, so a small destination can be broadcast by the adaptive
planner; deletes need a full outer join. Only the columns a mode compares
are carried through the join: content never is, hashes only for checksum
mode.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sparksync.functions.paths import ancestors, under_any
from sparksync.functions.skew import hot_of_counts, lookup_join
from sparksync.sources.manifest import with_manifest_columns

PERMISSION_BITS = 0o7777
SPECIAL_KINDS = ("fifo", "socket", "block", "char")


@dataclass(frozen=True)
class PlanFlags:
    """Decision flags of a run."""

    checksum: bool = False
    size_only: bool = False
    update_only: bool = False
    ignore_existing: bool = False
    existing: bool = False
    ignore_times: bool = False
    perms: bool = True
    times: bool = True
    delete: bool = False

    def columns(self) -> list[str]:
        names = ["path", "kind", "size", "mode", "mtime_sec", "mtime_nsec", "link_target", "rdev"]
        return names + (["hash"] if self.checksum else [])


def _is_special(kind: Column) -> Column:
    return kind.isin(*SPECIAL_KINDS)


def _times_match(s, d) -> Column:
    return (s("mtime_sec") == d("mtime_sec")) & (s("mtime_nsec") == d("mtime_nsec"))


def _content_verdict(flags: PlanFlags, s, d) -> Column:
    """Reason string for rows present on both sides; '' means in sync, '=...' a forced skip."""
    both_plain = (s("kind") != "dir") & (d("kind") != "dir")
    any_link = s("link_target").isNotNull() | d("link_target").isNotNull()
    same_link = s("link_target") == d("link_target")
    if not (flags.checksum or flags.size_only):
        same_link = same_link & _times_match(s, d)
    same_special = (
        (s("kind") == d("kind"))
        & s("rdev").eqNullSafe(d("rdev"))
        & (s("mtime_sec") == d("mtime_sec"))
    )

    rule = F.when((s("kind") == "dir") & (d("kind") == "dir"), "")
    if flags.ignore_existing:
        rule = rule.when(both_plain, "=exists")
    rule = rule.when((s("kind") == "dir") != (d("kind") == "dir"), "type")
    rule = rule.when(any_link, F.when(F.coalesce(same_link, F.lit(False)), "").otherwise("link"))
    rule = rule.when(
        _is_special(s("kind")) | _is_special(d("kind")), F.when(same_special, "").otherwise("special")
    )
    if flags.update_only:
        rule = rule.when(d("mtime_sec") > s("mtime_sec"), "=newer")
    if flags.ignore_times:
        return rule.otherwise("forced")
    if flags.checksum:
        same_hash = F.coalesce(s("hash") == d("hash"), F.lit(False))
        return rule.otherwise(F.when(same_hash, "").otherwise("hash"))
    rule = rule.when(s("size") != d("size"), "size")
    if flags.size_only:
        return rule.otherwise("")
    return rule.when(~_times_match(s, d), "time").otherwise("")


def _attribute_drift(flags: PlanFlags, s, d) -> Column:
    """Reason string when preserved attributes of an in-sync regular file differ, else ''."""
    drift = F.when(F.lit(False), "")
    if flags.perms:
        masked = lambda c: c.bitwiseAND(F.lit(PERMISSION_BITS))
        drift = drift.when(masked(s("mode")) != masked(d("mode")), "mode")
    if flags.times:
        drift = drift.when(~_times_match(s, d), "mtime")
    return drift.otherwise("")


def _content_matches(flags: PlanFlags, s, d) -> Column:
    """Whether the destination surely holds the source's content, flags aside."""
    if flags.checksum:
        same = s("hash") == d("hash")
    else:
        same = s("size") == d("size")
        if not flags.size_only:
            same = same & _times_match(s, d)
    return F.coalesce(same, F.lit(False))


def _joined(src: DataFrame, dst: DataFrame, flags: PlanFlags, extra: list[str]) -> DataFrame:
    left = with_manifest_columns(src, flags.columns() + extra)
    right = with_manifest_columns(dst, flags.columns())
    left = left.select(*[F.col(c).alias(f"s_{c}") for c in left.columns])
    right = right.select(*[F.col(c).alias(f"d_{c}") for c in right.columns])
    how = "full_outer" if flags.delete else "left"
    return left.join(right, F.col("s_path") == F.col("d_path"), how)


def plan_sync(
    src: DataFrame,
    dst: DataFrame,
    delete_scope: list[str] | None = None,
    keep: list[str] = (),
    **flags: bool,
) -> DataFrame:
    """Decide create / update / delete / meta / skip for every path.

    ``keep`` names source columns to carry along. ``content_matched`` tells
    whether an in-sync destination file certainly holds the source's bytes.
    Deletes appear only with ``delete=True``, within ``delete_scope`` if given,
    but for those with the reason ``replaced``: what lies below a directory
    that gives way to something else goes with it, whatever the flags.
    """
    f = PlanFlags(**flags)
    s = lambda c: F.col(f"s_{c}")
    d = lambda c: F.col(f"d_{c}")
    joined = _joined(src, dst, f, list(keep))
    in_src, in_dst = s("path").isNotNull(), d("path").isNotNull()

    verdict = _content_verdict(f, s, d)
    drift = _attribute_drift(f, s, d)
    forced = F.col("_verdict").startswith("=")
    plain = (s("kind") != "dir") & s("link_target").isNull() & ~_is_special(s("kind"))
    if f.update_only:
        forced = forced | (d("mtime_sec") > s("mtime_sec"))

    create = F.lit("create")
    if f.existing:
        create = F.when(s("kind") == "dir", "create").otherwise("skip")
    action = (
        F.when(~in_src, "delete")
        .when(~in_dst, create)
        .when((F.col("_verdict") != "") & ~F.col("_verdict").startswith("="), "update")
        .when(plain & ~forced & (F.col("_drift") != ""), "meta")
        .otherwise("skip")
    )
    reason = (
        F.when(F.col("action") == "delete", "extraneous")
        .when(~in_dst, F.when(F.col("action") == "create", "new").otherwise("absent"))
        .when(F.col("action") == "update", F.col("_verdict"))
        .when(F.col("action") == "meta", F.col("_drift"))
        .when(F.col("_verdict") != "", F.expr("substring(_verdict, 2)"))
        .otherwise("in-sync")
    )
    matched = (
        in_src & in_dst
        & (s("kind") == "file") & d("link_target").isNull()
        & F.col("action").isin("skip", "meta")
        & _content_matches(f, s, d)
    )
    plan = (
        joined.withColumn("_verdict", F.when(in_src & in_dst, verdict).otherwise(""))
        .withColumn("_drift", F.when(in_src & in_dst, drift).otherwise(""))
        .withColumn("action", action)
    )
    if f.delete and delete_scope is not None:
        scoped = under_any(F.translate(d("path"), "\\", "/"), [r.replace("\\", "/") for r in delete_scope])
        plan = plan.filter((F.col("action") != "delete") | scoped)
    plan = plan.select(
        F.coalesce(s("path"), d("path")).alias("path"),
        F.coalesce(s("kind"), d("kind")).alias("kind"),
        "action",
        reason.alias("reason"),
        F.when(F.col("action") == "delete", 0).otherwise(s("size")).cast("bigint").alias("source_size"),
        F.coalesce(matched, F.lit(False)).alias("content_matched"),
        *[s(c).alias(c) for c in keep],
    )
    if "kind" not in src.columns or "kind" not in dst.columns:
        return plan
    cleared = below_replaced(src, dst, replaced_directories(plan)).select(
        "path", "kind", F.lit("delete").alias("action"), F.lit("replaced").alias("reason"), F.lit(0).cast("bigint").alias("source_size"),
        F.lit(False).alias("content_matched"), *[F.lit(None).cast(plan.schema[c].dataType).alias(c) for c in keep],
    )
    if f.delete:
        plan = plan.join(cleared.select("path", F.lit(True).alias("_cleared")), "path", "left").filter("_cleared is null").drop("_cleared")
    return plan.unionByName(cleared)


def replaced_directories(plan: DataFrame) -> DataFrame:
    """(path) of the directories that give way to something else."""
    return plan.filter((F.col("action") == "update") & (F.col("reason") == "type") & (F.col("kind") != "dir")).select("path")


def below_replaced(src: DataFrame, dst: DataFrame, replaced: DataFrame) -> DataFrame:
    """Destination entries below a replaced directory that the source does not name: (path, kind, root).

    The join is of the paths' ancestors with the few replaced directories,
    which Spark broadcasts once it has seen their size.
    """
    up = dst.select("path", "kind", F.explode(ancestors(F.col("path"))).alias("root"))
    return up.join(replaced.select(F.col("path").alias("root")), "root").join(src.select("path"), "path", "left_anti").groupBy("path", "kind").agg(
        F.min("root").alias("root")
    )


def plan_checksum(src: DataFrame, dst: DataFrame, **kw) -> DataFrame:
    return plan_sync(src, dst, checksum=True, **kw)


def plan_size_only(src: DataFrame, dst: DataFrame, **kw) -> DataFrame:
    return plan_sync(src, dst, size_only=True, **kw)


def plan_update_only(src: DataFrame, dst: DataFrame, **kw) -> DataFrame:
    return plan_sync(src, dst, update_only=True, **kw)


def plan_ignore_existing(src: DataFrame, dst: DataFrame, **kw) -> DataFrame:
    return plan_sync(src, dst, ignore_existing=True, **kw)


def plan_existing(src: DataFrame, dst: DataFrame, **kw) -> DataFrame:
    return plan_sync(src, dst, existing=True, **kw)


def plan_ignore_times(src: DataFrame, dst: DataFrame, **kw) -> DataFrame:
    return plan_sync(src, dst, ignore_times=True, **kw)


def plan_meta_only(src: DataFrame, dst: DataFrame, **kw) -> DataFrame:
    """The rows whose content is in sync but whose mode or mtime drifted."""
    return plan_sync(src, dst, **kw).filter(F.col("action") == "meta")


def assign_hardlinks(src: DataFrame, dst: DataFrame, group: str = "inode", **flags) -> DataFrame:
    """A plan with ``link_to`` for members of a link group that need no transfer of their own.

    ``group`` names the column that the members share.

    The representative of a group is its first content-matched member by path,
    otherwise its first transferred one. It is found with one map-side
    combined minimum, so a group that holds a large share of all files costs
    no large window; the join back spreads such a group.
    """
    plan = plan_sync(src, dst, keep=[group], **flags)
    transferred = F.col("action").isin("create", "update")
    member = (F.col("kind") == "file") & F.col(group).isNotNull()
    order = F.struct(F.when(F.col("content_matched"), 0).otherwise(1).alias("rank"), "path")
    groups = (
        plan.filter(member & (transferred | F.col("content_matched")))
        .groupBy(group)
        .agg(F.min(order).alias("rep"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    reps = groups.select(F.col(group).alias("_group"), F.col("rep.path").alias("_rep"))
    hot = hot_of_counts(groups, group, "n", ties=["rep"]).select(F.col(group).alias("_group"))
    # Only transferred members can become links; other rows get no group and
    # so spread freely.
    wanting = plan.withColumn("_group", F.when(member & transferred, F.col(group)))
    joined = lookup_join(wanting, reps, "_group", spread="path", hot=hot)
    link_to = F.when(F.col("_rep") != F.col("path"), F.col("_rep"))
    return joined.withColumn("link_to", link_to).drop("_rep", "_group")
