"""How often two values occur in the same record, and how far that exceeds chance.

Values are trimmed and count once in a record; rows that repeat a record are merged. Ordered pairs
are emitted from each record's sorted values and counted with map-side combining, and lift and
pointwise mutual information come from the marginal counts.

A pair is wanted from a lift of ``min_lift``: n(x,y) * N >= min_lift * n(x) * n(y). As n(x,y) is at
most n(y), a value in more than N / min_lift records can't be in such a pair, so it is left out before
pairs are emitted. There are at most min_lift times as many such values as an average record holds,
which bounds what is broadcast.

Defined results: null, empty and unreadable lists hold no values, blank values are none; records
without a key are left out; a record with one value gives no pair; an empty table gives no rows;
further columns are ignored. Very long lists are emitted as a stream, never as one array of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions.sql import sql
from marginalia.functions.text import trim_ws


def json_values(x: str) -> Column:
    """The distinct trimmed values of a JSON list, sorted by code point; empty for anything else."""
    parsed = F.from_json(F.col(x), "array<string>", {"mode": "PERMISSIVE"})
    trimmed = F.transform(F.coalesce(parsed, F.array().cast("array<string>")), trim_ws)
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda v: v.isNotNull() & (v != ""))))


def baskets(records: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """(kind, members): one row for each record and kind with at least one value."""
    merged = (
        records.where(F.col(key).isNotNull())
        .select(F.col(key).alias("_key"), *(json_values(column).alias(f"_{kind}") for kind, column in kinds.items()))
        .groupBy("_key")
        .agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_set(f"_{kind}")))).alias(f"_{kind}") for kind in kinds))
    )
    stacked = merged.select(F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(f"_{kind}").alias("members")) for kind in kinds))).alias("b"))
    return stacked.select("b.kind", "b.members").where(F.size("members") > 0)


def pair_counts(records: DataFrame, key: str, kinds: dict[str, str], min_pairs: int = 5, min_lift: int = 4) -> DataFrame:
    """(kind, left_value, right_value, n_both, n_left, n_right, n_all, lift, pmi) of the pairs above both bounds."""
    spark = records.sparkSession
    held = baskets(records, key, kinds)
    totals = held.groupBy("kind").agg(F.count("*").alias("n_all"))
    singles = held.select("kind", F.explode("members").alias("value")).groupBy("kind", "value").agg(F.count("*").alias("n"))
    frequent = sql(
        spark,
        """
        SELECT kind, collect_list(value) AS hot FROM {singles} JOIN {totals} USING (kind)
        WHERE n * {lift} > n_all GROUP BY kind""",
        singles=singles,
        totals=totals,
        lift=min_lift,
    )
    emitted = sql(
        spark,
        """
        SELECT kind, left_value, explode(slice(members, place + 2, size(members))) AS right_value
        FROM (
          SELECT kind, members, posexplode(members) AS (place, left_value)
          FROM (SELECT /*+ BROADCAST(f) */ h.kind, IF(hot IS NULL, members, array_except(members, hot)) AS members
                FROM {held} h LEFT JOIN {frequent} f ON h.kind = f.kind)
          WHERE size(members) > 1)""",
        held=held,
        frequent=frequent,
    )
    counted = emitted.groupBy("kind", "left_value", "right_value").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= min_pairs)
    return sql(
        spark,
        """
        SELECT c.kind, left_value, right_value, n_both, a.n AS n_left, b.n AS n_right, n_all,
               n_both * n_all / (a.n * b.n) AS lift, log2(n_both * n_all / (a.n * b.n)) AS pmi
        FROM {counted} c
        JOIN {singles} a ON c.kind = a.kind AND c.left_value = a.value
        JOIN {singles} b ON c.kind = b.kind AND c.right_value = b.value
        JOIN {totals} t ON c.kind = t.kind
        WHERE n_both * n_all >= {lift} * a.n * b.n""",
        counted=counted,
        singles=singles,
        totals=totals,
        lift=min_lift,
    )
