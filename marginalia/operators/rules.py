"""Ordered keyword rules as data: which rule a text meets first, and which keyword it met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: (group, name, keywords in order)
Rules = list[tuple[str, str, list[str]]]


def first_hit(blob: Column, keywords: list[str]) -> Column:
    """The first keyword that the text holds, or null."""
    return F.coalesce(*(F.when(blob.contains(k.lower()), F.lit(k)) for k in keywords))


def first_rule(blob: Column, rules: list[tuple[str, list[str]]], otherwise: str | None = None) -> Column:
    """The name of the first rule with a keyword in the text. Rules are a list in the plan, so no join is needed."""
    return F.coalesce(*(F.when(first_hit(blob, ks).isNotNull(), F.lit(name)) for name, ks in rules), F.lit(otherwise))


def rule_hits(rows: DataFrame, key: str, blob: Column, rules: Rules) -> DataFrame:
    """(key, rule_group, rule_name, keyword): every rule that a row meets, with its first keyword."""
    hits = F.array(
        *(
            F.struct(F.lit(group).alias("rule_group"), F.lit(name).alias("rule_name"), first_hit(F.col("_blob"), keywords).alias("keyword"))
            for group, name, keywords in rules
        )
    )
    met = rows.select(key, blob.alias("_blob")).select(key, F.explode(F.filter(hits, lambda h: h["keyword"].isNotNull())).alias("_h"))
    return met.select(key, "_h.rule_group", "_h.rule_name", "_h.keyword")


def topics_of(rows: DataFrame, key: str, tags: Column, topics: list[tuple[str, str]], none: str = "UNCLASSIFIED") -> DataFrame:
    """(key, topic): topics whose label is part of a row's joined tags or whose code is one of them; else ``none``."""
    joined = F.lower(F.array_join(F.col("_tags"), "; "))
    hits = F.filter(
        F.array(*(F.when(joined.contains(label.lower()) | F.array_contains(F.col("_tags"), code), F.lit(code)) for code, label in topics)), lambda x: x.isNotNull()
    )
    return rows.select(key, tags.alias("_tags")).select(key, F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(none)))).alias("topic"))
