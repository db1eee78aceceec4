"""Where links of an inventory really lead, and what a followed link brings in.

A link's target may be a link itself, or lie behind one. ``final_targets``
finds the end of every chain by pointer doubling: each link holds the farthest
path it is known to lead to, and a round replaces the first link on that path
by the farthest path of that link. Rounds are logarithmic in the chain length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from sparksync.functions import paths
from sparksync.functions.skew import lookup_join
from sparksync.session import checkpointed

#: Fixed value: links that an operating system follows in one path before it reports a loop.
MAX_HOPS = 40


def absolute(path: Column, root: str) -> Column:
    """The absolute place of a path below ``root``; '' is the root itself."""
    top = root.rstrip("/")
    return F.when(path == "", F.lit(top or "/")).otherwise(F.concat(F.lit(top + "/"), path))


def below_root(place: Column, root: str) -> Column:
    """An absolute place as a path below ``root``; '' for the root itself, null outside of it."""
    top = root.rstrip("/")
    inside = F.substr(place, F.lit(len(top) + 2), F.length(place))
    return F.when(place == (top or "/"), "").when(place.startswith(top + "/"), inside)


def written_target(place: Column, target: Column) -> Column:
    """The absolute path that a link at ``place`` names, '..' not yet cancelled."""
    return F.when(target.startswith("/"), target).otherwise(F.concat(paths.parent(place), F.lit("/"), target))


def final_targets(links: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(place, final, hops) of links given as (place, link_target) with absolute, normalised places.

    ``final`` is the normalised path at the end of the chain, whether or not
    something is there; '..' is applied after the links before it. It is null
    for a link that leads into a loop, that is through more than ``max_hops``
    links. ``hops`` counts the links passed, the link itself included.
    """
    named = links.filter(F.col("link_target").isNotNull()).dropDuplicates(["place"])
    none = F.array().cast("array<string>")
    # A link is scanned for the first link on its path, waits for it ("via"), or has its end in ``path``.
    state = checkpointed(
        named.select(
            "place", written_target(F.col("place"), F.col("link_target")).alias("path"), F.lit(None).cast("string").alias("via"), none.alias("rest"),
            F.lit(1).alias("hops"), F.lit("scan").alias("state"),
        )
    )
    left = {"scan"}
    while left:
        if "scan" in left:
            state = _scanned(state)
        other = state.select(
            F.col("place").alias("via"), *[F.col(c).alias(f"via_{c}") for c in ("via", "path", "rest", "hops", "state")]
        )
        # Many links may wait for one; the adaptive skew join splits them.
        met = state.filter("state = 'via'").join(other, "via", "left")
        hops = F.when(F.col("via_state") == "scan", F.col("hops")).otherwise(F.least(F.col("hops") + F.col("via_hops"), F.lit(max_hops + 1)))
        ended = F.col("via_state") == "end"
        moved = met.select(
            "place",
            F.when(ended, F.array_join(F.concat(F.array("via_path"), "rest"), "/")).otherwise(F.col("path")).alias("path"),
            F.when(F.col("via_state") == "via", F.col("via_via")).otherwise(F.col("via")).alias("via"),
            F.when(F.col("via_state") == "via", F.concat("via_rest", "rest")).when(ended, none).otherwise(F.col("rest")).alias("rest"),
            hops.alias("hops"),
            F.when(hops > max_hops, "end").when(ended, F.when(F.size("rest") > 0, "scan").otherwise("end")).otherwise("via").alias("state"),
        )
        # The states are counted while the round is written.
        counts = Observation()
        count_of = [F.count_if(F.col("state") == s).alias(s) for s in ("scan", "via")]
        state = checkpointed(state.filter("state != 'via'").unionByName(moved).observe(counts, *count_of))
        left = {s for s, n in counts.get.items() if n}
    return state.select("place", F.when(F.col("hops") <= max_hops, paths.normalize(F.col("path"))).alias("final"), "hops")


def _scanned(state: DataFrame) -> DataFrame:
    """Rows to scan with the first link on their path as ``via`` and what follows it as ``rest``; without one they have ended."""
    parts = F.split("path", "/")
    starts = F.transform(
        F.sequence(F.lit(2), F.size("parts")),
        lambda i: F.struct(i.alias("at"), paths.normalize(F.array_join(F.slice("parts", F.lit(1), i), "/")).alias("via")),
    )
    # A link has nothing below it in an inventory: only the first one on a path can be met before '..' is applied.
    open_ = state.filter("state = 'scan'").select("place", "path", "hops", parts.alias("parts"))
    spots = open_.filter(F.size("parts") > 1).select("place", F.explode(starts).alias("s")).select("place", "s.at", "s.via")
    first = spots.join(state.select(F.col("place").alias("via")), "via").groupBy("place").agg(F.min(F.struct("at", "via")).alias("m"))
    rest = F.slice("parts", F.col("m.at") + 1, F.greatest(F.size("parts") - F.col("m.at"), F.lit(0)))
    done = open_.join(first, "place", "left").select(
        "place", "path", F.col("m.via").alias("via"), F.when(F.col("m").isNotNull(), rest).otherwise(F.array().cast("array<string>")).alias("rest"), "hops",
        F.when(F.col("m").isNotNull(), "via").otherwise("end").alias("state"),
    )
    return checkpointed(state.filter("state != 'scan'").unionByName(done))


def all_places(entries: DataFrame, external: DataFrame, root: str) -> DataFrame:
    """(place, kind, link_target) of the inventory and of what is known outside of it."""

    def shaped(df: DataFrame, place: Column) -> DataFrame:
        target = F.col("link_target") if "link_target" in df.columns else F.lit(None).cast("string")
        kind = F.when(target.isNotNull(), "symlink").otherwise(F.col("kind"))
        return df.select(place.alias("place"), kind.alias("kind"), target.alias("link_target"))

    return shaped(entries, absolute(F.col("path"), root)).unionByName(shaped(external, paths.normalize(F.col("path"))))


def real_kinds(places: DataFrame, root: str) -> DataFrame:
    """(place, kind) of everything that is no link; directories that are only implied by what lies below them included."""
    listed = places.filter(F.col("kind") != "symlink").select("place", "kind")
    above = F.transform(paths.ancestors(F.substr(F.col("place"), F.lit(2), F.length("place"))), lambda p: F.concat(F.lit("/"), p))
    implied = places.select(F.explode(above).alias("place")).distinct().withColumn("kind", F.lit("dir"))
    top = places.sparkSession.range(1).select(F.lit(root.rstrip("/") or "/").alias("place"), F.lit("dir").alias("kind"))
    # A listed kind wins over an implied directory.
    return listed.unionByName(implied).unionByName(top).groupBy("place").agg(F.max_by("kind", F.when(F.col("kind") == "dir", 0).otherwise(1)).alias("kind"))


def resolved_links(places: DataFrame, root: str, max_hops: int = MAX_HOPS) -> DataFrame:
    """(place, final, hops, target_kind) of every link; ``target_kind`` is null where nothing is known at the end."""
    ends = final_targets(places.filter(F.col("kind") == "symlink").select("place", "link_target"), max_hops)
    kinds = real_kinds(places, root).select(F.col("place").alias("final"), F.col("kind").alias("target_kind"))
    return lookup_join(ends, kinds, "final", spread="place")


def followed_entries(entries: DataFrame, external: DataFrame, root: str = "/root", max_hops: int = MAX_HOPS) -> DataFrame:
    """The inventory with every link read through: (path, kind, source, dereferenced, reason).

    A link to a file becomes a file, a link to a directory becomes a directory
    with all that lies below its referent, and links met there are followed in
    turn. ``source`` is the absolute place that an entry is read from;
    ``dereferenced`` marks entries that came through a link. Links that end
    nowhere, loop, or lead to a directory that was already entered on the way
    have a ``reason`` and no kind. Unlike a walk in file order the result does
    not depend on the order: two links to one directory both get its content.

    Each round extends the chains of directory links by one; rounds end with
    the deepest nesting of directory links, and entries are joined to the
    directories once, by directory.
    """
    places = checkpointed(all_places(entries, external, root))
    ends = checkpointed(resolved_links(places, root, max_hops))
    # What lies below a directory: entries once per directory above them.
    above = F.transform(paths.ancestors(F.substr(F.col("place"), F.lit(2), F.length("place"))), lambda p: F.concat(F.lit("/"), p))
    spread = lambda df, *cols: df.select(F.explode(F.concat(F.array(F.lit("/")), above)).alias("dir"), "place", *cols).withColumn(
        "rest", F.substr(F.col("place"), F.when(F.col("dir") == "/", F.lit(2)).otherwise(F.length("dir") + 2), F.length("place"))
    )
    below_links = checkpointed(spread(ends.filter("target_kind = 'dir'"), "final"))
    inside = below_root(F.col("place"), root)
    mine = ends.withColumn("path", inside).filter(F.col("path").isNotNull() & (F.col("path") != ""))
    found = checkpointed(mine.filter("target_kind = 'dir'").select("path", F.col("final").alias("dir"), F.array("final").alias("entered")))
    rounds = [found]
    while not found.isEmpty():
        nested = found.join(below_links, "dir")
        found = checkpointed(
            nested.filter(~F.array_contains("entered", F.col("final"))).select(
                F.concat_ws("/", "path", "rest").alias("path"), F.col("final").alias("dir"), F.concat("entered", F.array("final")).alias("entered")
            )
        )
        rounds.append(found)
    opened = rounds[0]
    for more in rounds[1:]:
        opened = opened.unionByName(more)

    missing = F.when(F.col("final").isNull(), "leads into a loop").otherwise("nothing at the end of the link")
    plain = places.filter(F.col("kind") != "symlink").select(
        below_root(F.col("place"), root).alias("path"), "kind", F.col("place").alias("source"), F.lit(False).alias("dereferenced"), F.lit(None).cast("string").alias("reason")
    ).filter(F.col("path").isNotNull())
    ended = F.when(F.col("target_kind").isNull(), missing)
    top = mine.select(
        "path", F.col("target_kind").alias("kind"), F.coalesce("final", "place").alias("source"), F.lit(True).alias("dereferenced"), ended.alias("reason")
    )
    # Below an opened directory: what is there by itself, and the links that are there.
    real = places.filter(F.col("kind") != "symlink").withColumnRenamed("kind", "found_kind")
    content = opened.join(spread(real, "found_kind"), "dir").select(
        F.concat_ws("/", "path", "rest").alias("path"), F.col("found_kind").alias("kind"), F.col("place").alias("source"), F.lit(True).alias("dereferenced"),
        F.lit(None).cast("string").alias("reason"),
    )
    again = F.array_contains("entered", F.col("final")) & (F.col("target_kind") == "dir")
    met = opened.join(spread(ends, "final", "target_kind"), "dir").select(
        F.concat_ws("/", "path", "rest").alias("path"),
        F.when(~F.coalesce(again, F.lit(False)), F.col("target_kind")).alias("kind"),
        F.coalesce("final", "place").alias("source"),
        F.lit(True).alias("dereferenced"),
        F.when(again, "directory was already entered").otherwise(ended).alias("reason"),
    )
    return plain.unionByName(top).unionByName(content).unionByName(met)
