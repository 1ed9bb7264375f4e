"""Counts, shares, top values, entropy and pair measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def value_counts(rows: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias(name))


def top_k(counts: DataFrame, k: int, n: str, ties: list[str]) -> DataFrame:
    """The k largest counts; equal counts in the order of ``ties``."""
    return counts.orderBy(F.desc(n), *ties).limit(k)


def top_per_group(counts: DataFrame, group: list[str], value: str, n: str, k: int) -> DataFrame:
    """(group, top): the k largest values of each group as ``value (n); ...``.

    The bound is applied by rank before the values of a group are gathered, so no list is longer than k.
    """
    ranked = counts.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(n), value))).where(F.col("_rank") <= k)
    listed = ranked.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_rank", F.concat(F.col(value), F.lit(" ("), F.col(n).cast("string"), F.lit(")")).alias("shown")))).alias("_list"))
    return listed.select(*group, F.array_join(F.transform("_list", lambda x: x["shown"]), "; ").alias("top"))


def normalized_entropy(counts: DataFrame, group: list[str], n: str) -> DataFrame:
    """(group, total, kinds, entropy): -sum p ln p / ln k of the counts of a group; 0 for one kind.

    Written with sums only, -sum(n ln n)/N + ln N, so it is one map-side combined aggregate.
    """
    sums = counts.groupBy(*group).agg(F.sum(n).alias("total"), F.count("*").alias("kinds"), F.sum(F.col(n) * F.log(F.col(n))).alias("_s"))
    value = (F.log("total") - F.col("_s") / F.col("total")) / F.log("kinds")
    return sums.select(*group, "total", "kinds", F.when(F.col("kinds") > 1, value).otherwise(F.lit(0.0)).alias("entropy"))


def pair_overlap(links: DataFrame, member: str, group: str) -> DataFrame:
    """(left_value, right_value, n_both, n_left, n_right, jaccard) of groups that share members.

    ``links`` has one row per member and group. Pairs are emitted from each member's sorted groups.
    """
    distinct = links.select(member, group).distinct()
    sizes = distinct.groupBy(group).agg(F.count("*").alias("_n"))
    sets = distinct.groupBy(member).agg(F.array_sort(F.collect_set(group)).alias("_groups")).where(F.size("_groups") > 1)
    left = sets.select("_groups", F.posexplode("_groups").alias("_place", "left_value"))
    pairs = left.select("left_value", F.explode(F.expr("slice(_groups, _place + 2, size(_groups))")).alias("right_value"))
    both = pairs.groupBy("left_value", "right_value").agg(F.count("*").alias("n_both"))
    a, b = sizes.select(F.col(group).alias("left_value"), F.col("_n").alias("n_left")), sizes.select(F.col(group).alias("right_value"), F.col("_n").alias("n_right"))
    joined = both.join(a, "left_value").join(b, "right_value")
    return joined.select("left_value", "right_value", "n_both", "n_left", "n_right", (F.col("n_both") / (F.col("n_left") + F.col("n_right") - F.col("n_both"))).alias("jaccard"))


def bridge_degree(pairs: DataFrame, least: int) -> DataFrame:
    """(value, degree): pairs with at least ``least`` common members that a value is in."""
    ends = pairs.where(F.col("n_both") >= least).select(F.explode(F.array("left_value", "right_value")).alias("value"))
    return ends.groupBy("value").agg(F.count("*").alias("degree"))


def failed_checks(rows: DataFrame, key: str, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """(key, issue, severity): one row for every check of a row that is true."""
    found = F.filter(
        F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))) for issue, severity, test in checks)),
        lambda x: x.isNotNull(),
    )
    return rows.select(key, F.explode(found).alias("_c")).select(key, "_c.issue", "_c.severity")


def profile(rows: DataFrame, columns: list[str], known) -> DataFrame:
    """(field, n_rows, n_known, n_distinct) of every column, in one pass over the table."""
    cells = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.when(known(c), F.col(c).cast("string")).alias("value")) for c in columns))).alias("_c"))
    return cells.groupBy("_c.field").agg(F.count("*").alias("n_rows"), F.count("_c.value").alias("n_known"), F.count_distinct("_c.value").alias("n_distinct"))


def mismatches(rows: DataFrame, key: str, pairs: list[tuple[str, Column, Column]], known) -> DataFrame:
    """(key, field, left_value, right_value) where both cells are known and differ."""
    found = F.array(*(F.when(known(a) & known(b) & (F.lower(F.trim(a)) != F.lower(F.trim(b))), F.struct(F.lit(f).alias("field"), a.alias("left_value"), b.alias("right_value"))) for f, a, b in pairs))
    return rows.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_m")).select(key, "_m.field", "_m.left_value", "_m.right_value")
