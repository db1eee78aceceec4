"""Include/exclude patterns compiled to column predicates.

The patterns are few and given by the caller, so they are compiled on the
driver; matching runs inside the scan stage without a UDF. The regular
expressions use only the syntax Java and RE2 share.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparksync.functions.paths import basename

_SPECIAL = set(r".^$|()[]{}*+?\-")


def quote(text: str) -> str:
    """Escape a literal for a regular expression."""
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def glob_regex(pattern: str) -> str:
    """``*`` and ``**`` match any run, slashes included; ``?`` matches one character."""
    return "".join(".*" if c == "*" else "." if c == "?" else quote(c) for c in pattern)


def segment_glob_regex(pattern: str) -> str:
    """Source globs: ``*``, ``?`` and ``[..]`` stay within a component, ``**`` crosses them."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "[" and "]" in pattern[i + 2:]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1:end]
            negated = body.startswith("!")
            out.append("(?!/)[" + ("^" if negated else "") + body[negated:].replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else quote(c))
            i += 1
    return "".join(out)


def pattern_predicate(pattern: str, path: Column) -> Column:
    """One pattern as a predicate on ``path``.

    A leading slash anchors at the root and then covers the named entry and
    its subtree. A pattern with an inner slash matches at any depth. A plain
    name is compared with the basename.
    """
    anchored = pattern.startswith("/")
    body = pattern.strip("/").removeprefix("**/")
    if not body:
        return F.lit(False)
    wild = "*" in body or "?" in body
    if anchored:
        named = path.rlike(r"(?s)\A" + glob_regex(body) + r"\z") if wild else path == body
        return named | path.startswith(body + "/")
    if "/" in body:
        return path.rlike("(?s)" + glob_regex(body) + r"\z") if wild else path.contains(body)
    name = basename(path)
    return name.rlike(r"(?s)\A" + glob_regex(body) + r"\z") if wild else name == body


def passes(path: Column, includes: list[str] = (), excludes: list[str] = ()) -> Column:
    """Any include beats any exclude, whatever the order; no pattern lets everything pass."""
    included, excluded = F.lit(False), F.lit(False)
    for p in includes:
        included = included | pattern_predicate(p, path)
    for p in excludes:
        excluded = excluded | pattern_predicate(p, path)
    return included | ~excluded
