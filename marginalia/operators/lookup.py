"""Look-ups with fallbacks, resumable scans and folded lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_fallback(rows: DataFrame, cache: DataFrame, keys: list[list[str]], value: str) -> DataFrame:
    """``value`` from the first of several key combinations that the cache holds; where none is held it is null.

    ``cache`` has the columns of the first combination; rows with null in the rest of them serve the shorter ones.
    """
    out, found = rows, []
    for k, columns in enumerate(keys):
        rest = [c for c in keys[0] if c not in columns]
        side = cache
        for c in rest:
            side = side.where(F.col(c).isNull())
        side = side.groupBy(*columns).agg(F.max(value).alias(f"_v{k}"))
        out = out.join(side, columns, "left")
        found.append(F.col(f"_v{k}"))
    return out.select(*rows.columns, F.coalesce(*found).alias(value))


def resume_after(rows: DataFrame, key: str, after: str, most: int) -> DataFrame:
    """The next rows behind a key in the order of keys: a page of a resumable scan, its size is the feature."""
    return rows.where(F.col(key) > after).orderBy(key).limit(most)


def unreported(rows: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Rows whose state says neither reported nor done."""
    done = state.where((F.coalesce("reported_at", F.lit("")) != "") | (F.coalesce("card_status", F.lit("")) == "done")).select(key).distinct()
    return rows.join(done, key, "left_anti")


def ordered_lists(rows: DataFrame, key: str, value: str, order: list[str], name: str) -> DataFrame:
    """(key, name): distinct values in the order of their first row; the order is aggregated per value first."""
    firsts = rows.groupBy(key, value).agg(F.min(F.struct(*order)).alias("_o"))
    return firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("_v")))).alias("_l")).select(key, F.transform("_l", lambda x: x["_v"]).alias(name))


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, otherwise: str) -> DataFrame:
    """A value from a table by key, with a default. The optimizer broadcasts the table if its size allows."""
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(otherwise)))


def deleted_above(nodes: DataFrame, ancestors: Column, deleted: DataFrame) -> DataFrame:
    """(node, deleted): is a node, or anything above it, deleted? ``ancestors`` is the list above each node."""
    chains = nodes.select("node", F.explode(F.concat(F.array("node"), ancestors)).alias("at"))
    gone = deleted.select(F.col("node").alias("at"), F.lit(True).alias("_gone")).distinct()
    return chains.join(gone, "at", "left").groupBy("node").agg(F.bool_or(F.coalesce("_gone", F.lit(False))).alias("deleted"))
