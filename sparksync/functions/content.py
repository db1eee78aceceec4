"""Expressions on byte content."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strong_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def byte_slice(data: Column, offset: Column, length: Column) -> Column:
    """Bytes ``offset .. offset + length`` (0-based) of a binary column."""
    return F.substring(data, (offset + 1).cast("int"), length.cast("int"))


# The bounds 700 and 32768 and the multiple of 8.
def auto_block_size(size: Column) -> Column:
    """Integer square root rounded down to a multiple of 8, kept within 700 .. 32768."""
    guess = F.floor(F.sqrt(size.cast("double"))).cast("bigint")
    root = (
        F.when(guess * guess > size, guess - 1)
        .when((guess + 1) * (guess + 1) <= size, guess + 1)
        .otherwise(guess)
    )
    return F.greatest(F.lit(700), F.least(F.lit(32768), root - root % 8)).cast("int")


def human_size(value: Column, suffix: str = "") -> Column:
    """1024-based size with one decimal, e.g. ``12.3M``."""
    units = ["B", "K", "M", "G", "T"]
    out = None
    for power, unit in enumerate(units):
        text = F.concat(F.format_string("%.1f", value / float(1024**power)), F.lit(unit + suffix))
        is_last = power == len(units) - 1
        cond = F.lit(True) if is_last else value < float(1024 ** (power + 1))
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out
