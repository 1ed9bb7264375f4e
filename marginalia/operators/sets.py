"""Set operations on array cells that keep order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def union_keep_order(a: Column, b: Column) -> Column:
    """Members of both, first occurrence counts."""
    return F.array_distinct(F.concat(a, b))


def append_missing(a: Column, b: Column) -> Column:
    """``a`` as it is, then members of ``b`` that it lacks."""
    return F.concat(a, F.array_except(b, a))


def remove(a: Column, b: Column) -> Column:
    """``a`` without members of ``b``; repeats in ``a`` stay."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def missing(wanted: Column, held: Column) -> Column:
    return F.array_except(wanted, held)


def sorted_distinct(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))
