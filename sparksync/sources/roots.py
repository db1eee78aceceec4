"""Choosing what to sync: several roots, file lists, pattern files, source globs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparksync.functions import globs, paths


def topmost_roots(
    roots: DataFrame, includes: list[str] = (), excludes: list[str] = ()
) -> DataFrame:
    """Distinct roots that lie below no other accepted root.

    A root the filter rejects is dropped first, so it covers nothing.
    """
    kept = roots.select("root").filter(globs.passes(F.col("root"), includes, excludes)).distinct()
    above = kept.select("root", F.explode(paths.ancestors(F.col("root"))).alias("above"))
    covered = above.join(kept.select(F.col("root").alias("above")), "above", "left_semi")
    return kept.join(covered.select("root"), "root", "left_anti")


def entries_under(manifest: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries equal to or below one of ``roots``, which must be topmost.

    The ancestors of the paths alone are joined with the roots.
    """
    up = F.explode(paths.ancestors(F.col("path"), include_self=True))
    tops = roots.select(F.col("root").alias("_above"))
    # Only paths are multiplied by their depth; the entries come back by a semi-join.
    hit = manifest.select("path", up.alias("_above")).join(tops, "_above", "left_semi").select("path")
    return manifest.join(hit.distinct(), "path", "left_semi")


def merge_roots(
    manifest: DataFrame, roots: DataFrame, includes: list[str] = (), excludes: list[str] = ()
) -> DataFrame:
    """Several roots of one inventory as one manifest, every entry once."""
    tops = topmost_roots(roots, includes, excludes)
    if not (includes or excludes):
        return entries_under(manifest, tops)
    # Only paths are multiplied by their depth; the entries come back by a semi-join.
    up = F.explode(paths.ancestors(F.col("path"), include_self=True)).alias("_above")
    rooted = manifest.select("path", up).join(tops.select(F.col("root").alias("_above")), "_above")
    # Everything from the root down to the entry must be visible; what lies
    # above the root was named by the caller.
    visible = F.forall(
        paths.ancestors(F.col("path"), include_self=True),
        lambda p: (F.char_length(p) < F.char_length("_above")) | globs.passes(p, includes, excludes),
    )
    return manifest.join(rooted.filter(visible).select("path").distinct(), "path", "left_semi")


def parse_file_list(lines: DataFrame) -> DataFrame:
    """Absolute entries of a list, one per line; blank lines and CR line ends are tolerated.

    A relative entry fails the query.
    """
    entry = F.regexp_replace("value", r"\A\s+|\s+\z", "")
    named = lines.select(entry.alias("entry")).filter(F.col("entry") != "")
    message = F.concat(F.lit("file list entries must be absolute paths, got "), F.col("entry"))
    checked = F.when(F.col("entry").startswith("/"), F.col("entry")).otherwise(
        F.raise_error(message).cast("string")
    )
    return named.select(F.regexp_replace(checked, r"(?s)\A.", "").alias("root")).withColumn(
        "root", F.regexp_replace("root", r"/+\z", "")
    )


def read_file_list(spark: SparkSession, location: str) -> DataFrame:
    return parse_file_list(spark.read.text(location))


def select_file_list(manifest: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries named by a parsed list with their subtrees, and the listed paths that do not exist.

    A directory may be implied by the entries below it.
    """
    # Distinct first: a directory above many entries would be one hot key.
    known = manifest.select(
        F.explode(paths.ancestors(F.col("path"), include_self=True)).alias("root")
    ).distinct()
    present = listed.join(known, "root", "left_semi")
    missing = listed.join(known, "root", "left_anti").distinct()
    return entries_under(manifest, topmost_roots(present)), missing


def parse_pattern_lines(lines: DataFrame) -> DataFrame:
    """Patterns, one per line: leading space stripped, comments and blank lines dropped."""
    text = F.regexp_replace(F.regexp_replace("value", r"\A\s+", ""), r"\r\z", "")
    return lines.select(text.alias("pattern")).filter(
        (F.col("pattern") != "") & ~F.col("pattern").rlike(r"\A[#;]")
    )


def read_pattern_file(spark: SparkSession, location: str) -> list[str]:
    """The patterns of a filter file; they become part of the query, hence a driver list."""
    return [r["pattern"] for r in parse_pattern_lines(spark.read.text(location)).collect()]


def glob_base(pattern: str) -> str:
    """Directory that holds the matches: text before the first metacharacter up to the last slash."""
    cut = min((pattern.find(c) for c in "*?[" if c in pattern), default=len(pattern))
    prefix = pattern[:cut].replace("\\", "/")
    base, slash, _ = prefix.rpartition("/")
    if not base:
        return "/" if slash else ""
    return "" if base == "." else base.removeprefix("./")


def expand_glob_source(manifest: DataFrame, pattern: str, must_match: bool = True) -> DataFrame:
    """Entries selected by a source glob with their subtrees, relative to the glob's base.

    A path that literally exists wins over the pattern. No match is an error
    unless ``must_match`` is off.
    """
    literal = pattern.removeprefix("./")
    exists = (F.col("path") == literal) | F.col("path").startswith(literal + "/")
    is_glob = any(c in pattern for c in "*?[")
    if not is_glob or not manifest.filter(exists).isEmpty():
        chosen, base = manifest.filter(exists), ""
    else:
        # An entry is chosen if it, or a directory above it, matches the glob.
        regex = r"(?s)\A" + globs.segment_glob_regex(literal) + r"(?:/.*)?\z"
        chosen, base = manifest.filter(F.col("path").rlike(regex)), glob_base(pattern)
    if must_match and chosen.isEmpty():
        raise ValueError(f"no files match source pattern '{pattern}'")
    if base in ("", "/"):
        return chosen
    return chosen.withColumn("path", F.expr(f"substring(path, {len(base) + 2})"))
