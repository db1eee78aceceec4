"""Bind a costly expression once inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    The optimizer may inline a column into a lambda that refers to it, and
    then evaluates it again for every element. A lambda variable is safe.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
