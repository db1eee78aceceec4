"""Decisions about symbolic links and permissions of an inventory table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sparksync.functions import paths
from sparksync.operators.link_targets import MAX_HOPS, absolute, all_places, below_root, final_targets, resolved_links
from sparksync.session import checkpointed

# Extensions that make a file from Windows executable.
EXEC_EXTENSIONS = ("exe", "bat", "cmd", "ps1", "sh", "pl", "py", "rb", "lua")


def resolve_links(links: DataFrame, root: str = "/root") -> DataFrame:
    """Add ``resolved`` (absolute, normalised target) and ``inside`` (path below the root, or null).

    Relative targets start at the link's own directory; ``root`` is the
    absolute place of the inventory.
    """
    here = F.concat_ws("/", F.lit(root), paths.parent(F.col("path")))
    full = F.when(F.col("link_target").startswith("/"), F.col("link_target")).otherwise(
        F.concat_ws("/", here, "link_target")
    )
    below = F.col("resolved").startswith(root.rstrip("/") + "/")
    inside = (
        F.when(F.col("resolved") == root, "")
        .when(below, F.expr(f"substring(resolved, {len(root.rstrip('/')) + 2})"))
    )
    return links.withColumn("resolved", paths.normalize(full)).withColumn("inside", inside)


def classify_links(
    links: DataFrame, external: DataFrame, root: str = "/root", entries: DataFrame | None = None, max_hops: int = MAX_HOPS
) -> DataFrame:
    """internal / external-file / external-dir / dangling-external per link, by the end of its chain.

    A chain that ends below the root is internal even when nothing is there.
    A chain without an end is judged by the target as it is written.
    ``external`` lists (path, kind[, link_target]) of what exists outside,
    ``entries`` the whole inventory. Added columns: ``final`` and
    ``final_inside`` (null for a loop), ``target_kind`` of what is at the end
    (null if nothing is known there), ``link_class``.
    """
    places = checkpointed(all_places(links if entries is None else entries, external, root))
    ends = resolved_links(places, root, max_hops).select(F.col("place").alias("_place"), "final", "target_kind")
    joined = resolve_links(links, root).withColumn("_place", absolute(F.col("path"), root)).join(ends, "_place", "left").drop("_place")
    joined = joined.withColumn("final_inside", below_root(F.col("final"), root))
    cls = (
        F.when(F.coalesce("final_inside", F.when(F.col("final").isNull(), F.col("inside"))).isNotNull(), "internal")
        .when(F.col("target_kind") == "dir", "external-dir")
        .when(F.col("target_kind").isNotNull(), "external-file")
        .otherwise("dangling-external")
    )
    return joined.withColumn("link_class", cls)


def rewrite_internal_links(links: DataFrame, root: str = "/root", external: DataFrame | None = None) -> DataFrame:
    """Internal links with the target written relative to the link's own directory.

    The target as written counts where it lies inside; a link that comes back
    inside by way of links outside gets the end of its chain.
    """
    if "link_class" not in links.columns:
        none = links.sparkSession.createDataFrame([], "path string, kind string, link_target string")
        links = classify_links(links, none if external is None else external, root)
    kept = links.filter(F.col("link_class") == "internal")
    return kept.withColumn("rewritten", _rewritten())


def _rewritten() -> Column:
    return paths.relative_to(paths.parent(F.col("path")), F.coalesce("inside", "final_inside"))


@dataclass(frozen=True)
class LinkPolicy:
    """skip > follow > literal > the literal switch of a class > default."""

    skip: bool = False
    follow: bool = False
    literal: bool = False
    literal_internal: bool = False
    literal_external_file: bool = False
    literal_external_dir: bool = False
    windows_target: bool = False


def link_policy(
    classified: DataFrame, policy: LinkPolicy = LinkPolicy(), followable: Column | None = None
) -> DataFrame:
    """What becomes of each classified link: link (with its target), content, or skip (with a reason).

    ``followable`` tells whether a link can be read through; by default a
    link can whose chain has an end where something is.
    """
    cls, target = F.col("link_class"), F.col("link_target")
    self_link = F.col("inside") == F.col("path")
    if followable is None:
        followable = F.col("target_kind").isNotNull()
    literal = ("link", target, None)
    # Each rule: (condition, outcome, target to write, reason).
    if policy.skip:
        rules = [(F.lit(True), "skip", None, "no links wanted")]
    elif policy.follow:
        rules = [
            (followable, "content", None, None),
            (F.lit(True), "skip", None, "no end to read"),
        ]
    elif policy.literal:
        rules = [(F.lit(True), *literal)]
    else:
        rewritten = _rewritten()
        keep_file = policy.literal_external_file and not policy.windows_target
        rules = [
            ((cls == "internal") & self_link, "skip", None, "names itself"),
            (cls == "internal", *(literal if policy.literal_internal else ("link", rewritten, None))),
            (cls == "external-file", *(literal if keep_file else ("content", None, None))),
            (
                cls == "external-dir",
                *(literal if policy.literal_external_dir else ("skip", None, "directory outside")),
            ),
            (F.lit(True), "skip", None, "nothing outside there"),
        ]

    def pick(value) -> Column:
        out = None
        for rule in rules:
            v = rule[value]
            v = v if isinstance(v, Column) else F.lit(v).cast("string")
            out = F.when(rule[0], v) if out is None else out.when(rule[0], v)
        return out

    return classified.select(
        "path",
        "link_class",
        pick(1).alias("outcome"),
        pick(2).alias("target"),
        pick(3).alias("reason"),
    )


def detect_link_cycles(links: DataFrame, root: str = "/root", max_hops: int = MAX_HOPS) -> DataFrame:
    """Links that cannot be followed to an end: self links, rings, directory loops.

    Chains are collapsed to their ends first, which finds self links and rings
    in logarithmic rounds. Of the others a link is harmless when nothing below
    its end is a link in question. Harmless links are peeled off; a round is a
    semi join against the set of directories that hold links in question, and
    their number is the deepest nesting of directories by links.
    """
    resolved = resolve_links(links, root).select("path", "inside", "link_target", absolute(F.col("path"), root).alias("place"))
    ends = final_targets(resolved.select("place", "link_target"), max_hops)
    known = checkpointed(resolved.join(ends, "place").select("path", "inside", F.col("final").isNull().alias("endless"), below_root(F.col("final"), root).alias("end")))
    rest = known.filter(F.col("endless") | F.col("end").isNotNull()).select("path", "inside", "endless", "end")
    count = rest.count()
    while count:
        holds = rest.select(F.explode(F.concat(F.array(F.lit("")), paths.ancestors(F.col("path")))).alias("end")).distinct()
        left = rest.filter("not endless").join(holds, "end", "left_semi").select("path", "inside", "endless", "end")
        rest = checkpointed(rest.filter("endless").unionByName(left))
        now = rest.count()
        if now == count:
            break
        count = now
    return rest.select("path", F.when(F.col("path") == F.col("inside"), "self").otherwise("loop").alias("cycle"))


def exec_hint(path: Column) -> Column:
    return F.coalesce(F.lower(paths.extension(path)).isin(*EXEC_EXTENSIONS), F.lit(False))


def final_mode(
    manifest: DataFrame, source_os: str = "unix", no_perms: bool = False, archive: bool = False
) -> DataFrame:
    """Permission bits to carry over; links carry none."""
    is_dir = F.col("kind") == "dir"
    if no_perms:
        mode = F.when(is_dir, 0o755).otherwise(0o644)
    elif source_os == "windows":
        mode = F.when(is_dir | exec_hint(F.col("path")), 0o755).otherwise(0o644)
    else:
        mode = F.col("mode").bitwiseAND(F.lit(0o7777 if archive else 0o777))
    if "link_target" in manifest.columns:
        mode = F.when(F.col("link_target").isNotNull(), 0).otherwise(mode)
    return manifest.withColumn("mode", mode.cast("int"))
