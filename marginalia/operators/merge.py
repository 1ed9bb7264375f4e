"""Keyed table maintenance as joins: upserts, scoped replacement, change events, folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.functions.text import is_known
from marginalia.session import cut_lineage


def last_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (nulls first, all other columns break ties).

    One shuffle by key. Partial maxima are taken before it; as rows hold strings the aggregate sorts.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(*keys, *(F.col("_last")[c].alias(c) for c in order + rest)).select(*rows.columns)


def add_missing_columns(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Columns of ``schema`` that are missing are added as nulls; nothing is dropped."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in schema.items() if c not in rows.columns})


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with their key; columns of ``keep_old`` keep a known old value."""
    kept = set(keep_old or [])
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")

    def pick(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
        if c in kept:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
        return F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*(pick(c) for c in old.columns))


def replace_scope(old: DataFrame, new: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``scope`` are taken out, then ``new`` is put in."""
    return old.join(scope.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def change_events(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """(key, event_type): new_item for unseen keys, updated_item where a compared column differs."""
    before = old.select(key, F.struct(*compare).alias("_before"))
    joined = new.join(before, key, "left")
    changed = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_before.{c}")) for c in compare))
    kind = F.when(F.col("_before").isNull(), "new_item").when(changed, "updated_item")
    return joined.select(key, kind.alias("event_type")).where("event_type IS NOT NULL")


def stale_runs(runs: DataFrame, now: Column, seconds: int, note: str) -> DataFrame:
    """Running rows whose heartbeat (or start) is missing or older than ``seconds`` become interrupted."""
    seen = F.coalesce("heartbeat_at", "started_at")
    stale = (F.col("status") == "running") & (seen.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(seen) > seconds))
    return runs.withColumns(
        {
            "status": F.when(stale, "interrupted").otherwise(F.col("status")),
            "finished_at": F.when(stale, F.coalesce("finished_at", now)).otherwise(F.col("finished_at")),
            "note": F.when(stale, F.concat_ws("; ", F.when(F.col("note") != "", F.col("note")), F.lit(note))).otherwise(F.col("note")),
        }
    )


def fill_unknown(rows: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Unknown cells are filled from the row of ``source`` with the same key, known cells stay."""
    other = source.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = rows.join(other, key, "left")
    return joined.select(*(F.when(~is_known(c) & is_known(f"_{c}"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def merge_known(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Known cells of ``fresh`` win, else the existing ones; every fresh row stays, and existing rows with a key that none has.

    Keys match in lower case; rows of ``existing`` without a key are dropped.
    """
    cells = [c for c in fresh.columns if c != key]
    old = existing.select(F.lower(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in cells)).where(is_known("_key"))
    new = fresh.withColumn("_key", F.when(is_known(key), F.lower(key)))
    joined = new.join(old, "_key", "left")
    merged = joined.select(key, *(F.when(is_known(c), F.col(c)).otherwise(F.when(is_known(f"_{c}"), F.col(f"_{c}")).otherwise("")).alias(c) for c in cells))
    rest = existing.withColumn("_key", F.lower(key)).where(is_known("_key")).join(new.select("_key").where("_key IS NOT NULL").distinct(), "_key", "left_anti")
    return merged.unionByName(rest.select(key, *cells))


def numbered(rows: DataFrame, column: str, order: list[Column]) -> DataFrame:
    """A running number over the whole table without one single window: counts of ranges are added up first.

    The rows are range-partitioned by ``order``; each partition numbers its own rows and is offset by
    the rows of the partitions before it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    spread = cut_lineage(spread)  # the numbers of partitions and rows must be the same for both sides of the join
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # a running sum over one row per partition
    offsets = sizes.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = spread.join(F.broadcast(offsets), "_part")  # one row per partition
    return joined.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(column))
