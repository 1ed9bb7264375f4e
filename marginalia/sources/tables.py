"""Parquet tables of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The whole table; column pruning and filters are left to the optimizer."""
    return spark.read.parquet(f"{base}/{name}.parquet")
