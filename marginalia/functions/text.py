"""String helpers as Column expressions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Cells that mean "no value".
UNKNOWN = ["", "?", "[]", "none", "null", "未填写"]

ColumnOrName = Column | str


def as_col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(x: ColumnOrName) -> Column:
    """Strip every Unicode white space, not only blanks."""
    return F.regexp_replace(as_col(x), r"(?U)^\s+|\s+$", "")


def is_known(x: ColumnOrName) -> Column:
    """False for null and for the placeholder values."""
    return F.coalesce(~F.lower(trim_ws(x)).isin(UNKNOWN), F.lit(False))


def known(x: ColumnOrName) -> Column:
    """The trimmed value, or null if it is unknown."""
    return F.when(is_known(x), trim_ws(x))


def journal_key(x: ColumnOrName) -> Column:
    """Lower case, letters, digits and underscore only."""
    return F.regexp_replace(F.lower(as_col(x)), r"[^\p{L}\p{N}_]+", "")


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x computed once, however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))
