"""Values mapped by tables that the caller gives, and plans of what would be changed, as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions.scalars import compact_token, split_list, text_of
from marginalia.functions.text import is_known, let, trim_ws


def mapped(x: Column, table: dict[str, str], otherwise: Column | str | None = None) -> Column:
    """The value that a small table gives for a cell, else a default."""
    pairs = F.create_map(*(F.lit(v) for pair in table.items() for v in pair)) if table else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(F.element_at(pairs, text_of(x)), otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def first_containing(x: Column, words: list[tuple[str, str]]) -> Column:
    """The value of the first word that a cell contains; an unknown cell gives null, any other stays as it is."""
    hits = [F.when(x.contains(word), F.lit(value)) for word, value in words]
    return F.when(is_known(x), F.coalesce(*hits, trim_ws(x)))


def topic_codes(x: Column) -> Column:
    """(code, label) of the topics ``T<number>_<name>`` in a list cell, one for each code, its first."""
    found = F.filter(
        F.transform(split_list(x, r";|,，、"), lambda v: F.struct(F.regexp_extract(v, r"\b(T\d+)_", 1).alias("code"), trim_ws(F.regexp_extract(v, r"(?s)\b(T\d+_.+)$", 1)).alias("label"))),
        lambda t: t["code"] != "",
    )
    return let(found, lambda ts: F.filter(ts, lambda t, i: F.array_position(F.transform(ts, lambda u: u["code"]), t["code"]) == i + 1))


def mapped_with_warnings(rows: DataFrame, key: str, fields: dict[str, dict[str, str]]) -> DataFrame:
    """(key, tags, warnings): each field's known value by its table; values that the table lacks are warnings ``field: value``."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), trim_ws(text_of(f)).alias("value"), mapped(trim_ws(text_of(f)), table).alias("tag")) for f, table in fields.items()))
    known = F.filter(cells, lambda c: is_known(c["value"]))
    return rows.select(key, known.alias("_c")).select(
        key,
        F.transform(F.filter("_c", lambda c: c["tag"].isNotNull()), lambda c: c["tag"]).alias("tags"),
        F.transform(F.filter("_c", lambda c: c["tag"].isNull()), lambda c: F.concat(c["field"], F.lit(": "), c["value"])).alias("warnings"),
    )


def gate(canonical: Column, prefix: str) -> Column:
    """Whether a mapped value may pass: it does with the prefix, is redirected with another, and dropped without any."""
    return F.when(F.startswith(canonical, F.lit(prefix)), "pass").when(is_known(canonical), "redirect").otherwise("drop")


def signals(rows: DataFrame, value: str, word: str) -> DataFrame:
    """Rows whose value holds a word, whatever signs and case it is written with."""
    return rows.where(compact_token(F.col(value)).contains(word))


def group_means(rows: DataFrame, keys: list[str], value: str, digits: int = 4) -> DataFrame:
    """(keys, n, mean): how many rows a group has, and the rounded mean of a value."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), digits).alias("mean"))


def hit_rates(members: DataFrame, hits: DataFrame, key: str, group: str) -> DataFrame:
    """(group, n, n_hits, rate): hits of a group's members for each of its members; above 1 where a member has several."""
    sizes = members.groupBy(group).agg(F.count_distinct(key).alias("n"))
    counts = members.select(group, key).distinct().join(hits.select(key), key).groupBy(group).agg(F.count("*").alias("n_hits"))
    joined = sizes.join(counts, group, "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    return joined.withColumn("rate", F.col("n_hits") / F.col("n"))


def overlay(old: Column, new: Column) -> Column:
    """A map with the keys of both, new values for old ones."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def _differ(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns))


def audit(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, before, after): JSON of the columns for every key whose row a plan would change."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}")).where(_differ(columns))
    side = lambda s: F.to_json(F.struct(*(F.col(f"{s}.{c}").alias(c) for c in columns)), {"ignoreNullFields": "false"})
    return joined.select(F.col(f"n.{key}").alias(key), side("o").alias("before"), side("n").alias("after"))


def inverse(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows that undo a plan: the state before it of every key that it changes, as ``upsert`` takes them."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}")).where(_differ(columns))
    return joined.select(F.col(f"o.{key}").alias(key), *(F.col(f"o.{c}").alias(c) for c in columns))


def action_documents(rows: DataFrame, key: str, action: str, fields: dict[str, Column], wanted: Column) -> DataFrame:
    """(key, document): one JSON action for every row that is wanted and has a key; nothing is carried out."""
    body = F.struct(F.col(key).alias("key"), F.lit(action).alias("action"), *(c.alias(n) for n, c in fields.items()))
    return rows.where(is_known(key) & wanted).select(key, F.to_json(body).alias("document"))
