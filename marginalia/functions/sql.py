"""Spark SQL over DataFrames given by name."""

from __future__ import annotations

import itertools
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_serial = itertools.count()


def sql(spark: SparkSession, text: str, **names: Any) -> DataFrame:
    """spark.sql with each ``{name}`` standing for a DataFrame, or for a piece of SQL text.

    Other braces stay as they are, so regular expressions need no doubling. The temporary views are
    dropped at once: the returned DataFrame holds the resolved plan.
    """
    views = []

    def stand_in(m: re.Match) -> str:
        value = names.get(m[1])
        if isinstance(value, DataFrame):
            view = f"_named_{next(_serial)}"
            value.createOrReplaceTempView(view)
            views.append(view)
            return view
        return m[0] if value is None else str(value)

    try:
        return spark.sql(re.sub(r"\{(\w+)\}", stand_in, text))
    finally:
        for view in views:
            spark.catalog.dropTempView(view)
