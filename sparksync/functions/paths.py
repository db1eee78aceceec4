"""Path expressions. Paths are '/'-separated strings relative to a root."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparksync.functions.binding import let


def ancestors(path: Column, include_self: bool = False) -> Column:
    """All parent directories of ``path`` from the top down, the path itself last if asked."""
    drop = 0 if include_self else 1
    return let(
        F.split(path, "/"),
        lambda parts: F.transform(
            F.slice(F.sequence(F.lit(1), F.size(parts)), F.lit(1), F.size(parts) - drop),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
        ),
    )


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Parent directory, '' for a top-level entry."""
    return F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)


def extension(path: Column) -> Column:
    """Text after the last dot of the basename, '' for a last dot; null without one or for a name like '.x'."""
    pattern = r"(?s)\A.+\.([^.]*)\z"
    return F.when(basename(path).rlike(pattern), F.regexp_extract(basename(path), pattern, 1))


def stem(path: Column) -> Column:
    """Basename without its extension."""
    base = basename(path)
    cut = F.regexp_extract(base, r"(?s)\A(.+)\.[^.]*\z", 1)
    return F.when(cut == "", base).otherwise(cut)


def under_any(path: Column, roots: list[str]) -> Column:
    """Whether ``path`` equals a root of a given short list or lies below one."""
    hit = F.lit(False)
    for root in roots:
        hit = hit | (path == root) | path.startswith(root + "/")
    return hit


def wire_path(path: Column) -> Column:
    """Backslashes become slashes."""
    return F.translate(path, "\\", "/")


def normalize(path: Column) -> Column:
    """Cancel '.', '..' and empty components lexically; '..' at the top is dropped."""
    stack = _resolved_parts(path)
    return F.concat(
        F.when(path.startswith("/"), "/").otherwise(""), F.array_join(stack, "/")
    )


def _resolved_parts(path: Column) -> Column:
    return F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when((part == "") | (part == "."), acc)
        .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(part))),
    )


def relative_to(from_dir: Column, target: Column) -> Column:
    """``target`` written relative to ``from_dir``; both relative to one root, '.' if equal."""
    a = F.filter(F.split(from_dir, "/"), lambda p: p != "")
    b = F.filter(F.split(target, "/"), lambda p: p != "")
    shared = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda acc, i: F.struct(
            F.when(acc["open"] & _same_at(a, b, i), acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            (acc["open"] & _same_at(a, b, i)).alias("open"),
        ),
    )["n"]
    up = F.array_repeat(F.lit(".."), F.size(a) - shared)
    down = F.slice(b, shared + 1, F.greatest(F.size(b) - shared, F.lit(0)))
    joined = F.array_join(F.concat(up, down), "/")
    return F.when(joined == "", ".").otherwise(joined)


def _same_at(a: Column, b: Column, i: Column) -> Column:
    return F.coalesce(F.get(a, i - 1) == F.get(b, i - 1), F.lit(False))
