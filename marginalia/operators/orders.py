"""Orders of reports as lists of columns, and a table's rows numbered in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.operators.merge import numbered

Order = list[Column]


def by_weight(*weights: str, then: tuple[str, ...]) -> Order:
    """Larger weights first, one after the other; then by name."""
    return [*(F.desc(w) for w in weights), *(F.asc(t) for t in then)]


def by_group(groups: tuple[str, ...], *weights: str, then: tuple[str, ...]) -> Order:
    """Groups in order of their names, within them larger weights first."""
    return [*(F.asc(g) for g in groups), *by_weight(*weights, then=then)]


def newest_first(time: str, key: str) -> Order:
    """The latest first, of equal times the greatest key; rows without a time last."""
    return [F.desc_nulls_last(time), F.desc(key)]


def shallow_first(path: str) -> Order:
    """Paths by depth, so that a path comes behind everything above it."""
    return [(F.length(path) - F.length(F.replace(F.col(path), F.lit("/"), F.lit("")))).asc(), F.asc(path)]


def by_number(x: Column, then: str) -> Order:
    """By an integer in a cell; a cell without one counts as 0."""
    return [F.coalesce(x.try_cast("long"), F.lit(0)).asc(), F.asc(then)]


def by_name(name: str, key: str) -> Order:
    """By name, case ignored, then by key."""
    return [F.lower(name).asc(), F.asc(key)]


def as_shown(cell: str, then: str) -> Order:
    """As a table on a page sorts a column: numbers by value and before words, words without regard to case."""
    number = F.col(cell).try_cast("double")
    return [number.asc_nulls_last(), F.lower(F.coalesce(cell, F.lit(""))).asc(), F.asc(then)]


def placed(rows: DataFrame, order: Order, name: str = "place") -> DataFrame:
    """Rows with their place in an order, without a sort of all of them in one task."""
    return numbered(rows, name, order)
