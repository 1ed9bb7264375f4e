"""Queries over the library's own tables: hierarchies and packed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.operators.hierarchy import collection_hierarchy
from marginalia.operators.packed import packed_values
from marginalia.sources.tables import read_table


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """The values of cells that hold two or more."""
    values = packed_values(read_table(spark, base, "first_author_affiliations"), read_table(spark, base, "reading_summary"))
    return values.where("n >= 2").select("field", "card_id", "pos", "value")


def p3_values(spark: SparkSession, base: str) -> DataFrame:
    """How often each value occurs in a field, single values included."""
    values = packed_values(read_table(spark, base, "first_author_affiliations"), read_table(spark, base, "reading_summary"))
    return values.groupBy("field", "value").agg(F.count("*").alias("n_cells"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    found = collection_hierarchy(read_table(spark, base, "collections"), ancestors=False)
    return found.select(F.col("node").alias("collection_key"), F.col("root").alias("root_key"), "depth", "path", "n_descendants")


def p5_descendants(spark: SparkSession, base: str) -> DataFrame:
    """Every pair of a collection and one of its descendants, with the steps between them."""
    found = collection_hierarchy(read_table(spark, base, "collections"))
    pairs = found.select(F.col("node").alias("descendant_key"), F.col("depth"), F.posexplode("ancestors").alias("place", "collection_key"))
    return pairs.select("collection_key", "descendant_key", (F.col("depth") - F.col("place")).alias("steps"))


_LATEST = """
    WITH RECURSIVE latest AS (
      SELECT trim(collection_key, e' \\t\\n\\r') AS node, name, trim(parent_key, e' \\t\\n\\r') AS parent,
             row_number() OVER (PARTITION BY trim(collection_key, e' \\t\\n\\r')
               ORDER BY last_seen_at DESC NULLS LAST, name DESC NULLS LAST, trim(parent_key, e' \\t\\n\\r') DESC NULLS LAST) AS place
      FROM collections WHERE trim(collection_key, e' \\t\\n\\r') <> ''),
    links AS (
      SELECT l.node, p.node AS parent, CASE WHEN trim(coalesce(l.name, '')) = '' THEN l.node ELSE l.name END AS name
      FROM latest l LEFT JOIN latest p ON p.node = l.parent AND p.place = 1 AND l.parent NOT IN ('', 'false')
      WHERE l.place = 1),
    tree AS (
      SELECT node, node AS root, 0 AS depth, name AS path, CAST([] AS VARCHAR[]) AS above FROM links WHERE parent IS NULL
      UNION ALL
      SELECT l.node, t.root, t.depth + 1, t.path || '/' || l.name, list_append(t.above, t.node) FROM links l JOIN tree t ON l.parent = t.node),
    pairs AS (SELECT node AS descendant_key, depth, unnest(above) AS collection_key, unnest(range(len(above))) AS place FROM tree)
"""

# Packed cells as DuckDB finds them: values are runs of characters that are no delimiters, or of whole quoted pieces, where the query folds pieces
def _cells(field: str, table: str, key: str) -> str:
    return f"""SELECT field, card_id, replace(CASE WHEN regexp_matches(cell, '^\\s*\\[\\s*''') THEN replace(cell, '''', '"') ELSE translate(cell, '“”＂', repeat(chr(34), 3)) END, ' / ', ';') AS cell
      FROM (SELECT DISTINCT '{field}' AS field, {key} AS card_id, "{field}" AS cell FROM {table} WHERE lower(trim("{field}")) NOT IN ('', '?', '[]', 'none', 'null', '未填写'))"""


def _runs(x: str, delimiters: str) -> str:
    return f"""regexp_extract_all({x}, '(?:[^{delimiters}"]|"[^"]*"|")+')"""


def _bare(x: str) -> str:
    return f"""regexp_replace({x}, '"([^"]*)"', '\\1', 'g')"""


def _addresses(x: str) -> str:
    for before, after in (("\\S", "\\s+(\\([0-9]+\\)\\s*\\p{Lu})"), ("\\S", "\\s+([a-z]\\s+\\p{Lu}\\p{Ll})"), ("\\p{L}", "\\s+([0-9]{1,2}[.]?\\s+\\p{Lu}\\p{Ll})"), ("\\S", "\\s*([¹²³⁴⁵⁶⁷⁸⁹])")):
        x = f"regexp_replace({x}, '({before}){after}', '\\1' || chr(10) || '\\2', 'g')"
    return x


_LINES = "\\t\\r\\n"
_LATIN = "[\\p{Latin}.''’-]+"
_PEOPLE = f"""CASE WHEN contains(s, '"') THEN {_runs("s", ",")}
   WHEN regexp_full_match(s, '\\s*[\\p{{Han}}·]+(\\s+[\\p{{Han}}·]+)+\\s*') THEN regexp_split_to_array(trim(s), '\\s+')
   WHEN NOT contains(s, ',') OR regexp_full_match(s, '\\s*{_LATIN},\\s*[\\p{{Latin}}.''’ -]+') THEN [s]
   WHEN regexp_full_match(s, '\\s*{_LATIN}(,\\s*{_LATIN})+\\s*') AND len(string_split(s, ',')) % 2 = 0 THEN regexp_extract_all(s, '[^,]+,[^,]+')
   ELSE string_split(s, ',') END"""
_MARK, _NUMBER = "'^(?:[\\s*†‡§¹²³⁴⁵⁶⁷⁸⁹⁰\\[\\]]|\\([0-9]+\\)|[0-9]{1,2}[.)]\\s)+'", "'^(?:[0-9]{1,2}|[a-z])\\s+(\\p{Lu})'"
_EDGE = "'^(?:[\\s\\[\\]*,]|\\([0-9]+\\)|[0-9]{1,2}[.)]\\s)+|[\\s\\[\\],]+$|[\\s,]+(?:et\\s+al\\.?|等人?)\\s*$'"
_JOINED = "regexp_replace(regexp_replace(cell, ',?\\s+(?:and|&)\\s+', ';', 'g'), '\\s*/\\s*', ';', 'g')"
_PACKED = f"""
    WITH held AS (SELECT field, card_id, list_filter(found, lambda v: v <> '' AND NOT regexp_full_match(v, 'et\\s+al\\.?|等人?')) AS found FROM (
      SELECT field, card_id, list_transform({_runs("cell", ";；,，|、" + _LINES)}, lambda v: trim({_bare("v")}, e' \\t\\n\\r[]')) AS found FROM ({_cells("Tags", "reading_summary", "人工参阅编号")})
      UNION ALL
      SELECT field, card_id, list_transform({_runs(_addresses("cell"), ";；|" + _LINES)}, lambda v: regexp_replace(regexp_replace(regexp_replace({_bare("v")}, {_MARK}, ''), {_NUMBER}, '\\1'), '[\\s\\[\\],]+$', ''))
      FROM ({_cells("first_author_affiliation_raw", "first_author_affiliations", "card_id")})
      UNION ALL
      SELECT field, card_id, list_transform(flatten(list_transform({_runs(_JOINED, ";；|、，" + _LINES)}, lambda s: {_PEOPLE})), lambda v: regexp_replace(regexp_replace({_bare("v")}, {_EDGE}, '', 'g'), {_EDGE}, '', 'g'))
      FROM ({_cells("作者", "reading_summary", "人工参阅编号")})))
"""

QUERIES = {"p3_found": p3_found, "p3_values": p3_values, "p5_found": p5_found, "p5_descendants": p5_descendants}

ORACLES = {
    "p3_found": _PACKED + " SELECT field, card_id, CAST(generate_subscripts(found, 1) AS INTEGER) AS pos, unnest(found) AS value FROM held WHERE len(found) >= 2",
    "p3_values": _PACKED + " SELECT field, value, count(*) AS n_cells FROM (SELECT field, card_id, unnest(found) AS value FROM held) GROUP BY ALL",
    "p5_found": _LATEST
    + """
    SELECT l.node AS collection_key, coalesce(t.root, 'cycle') AS root_key, coalesce(t.depth, -1) AS depth, coalesce(t.path, '') AS path,
           CAST(CASE WHEN t.node IS NULL THEN -1 ELSE coalesce(d.n, 0) END AS INTEGER) AS n_descendants
    FROM links l LEFT JOIN tree t ON t.node = l.node
    LEFT JOIN (SELECT collection_key, count(*) AS n FROM pairs GROUP BY collection_key) d ON d.collection_key = l.node""",
    "p5_descendants": _LATEST + " SELECT collection_key, descendant_key, CAST(depth - place AS INTEGER) AS steps FROM pairs",
}
