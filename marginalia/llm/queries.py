"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.llm import canonical, contamination, cooccurrence, language, ocr, packing, spans, variants
from marginalia.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    mapped = canonical.map_venues(read_table(spark, base, "library_items"), read_table(spark, base, "journal_rankings"))
    return mapped.select("item_key", "normalized_name").distinct()


def p1_unmatched(spark: SparkSession, base: str) -> DataFrame:
    """Typed venues that the list doesn't hold, with the number of their items."""
    mapped = canonical.map_venues(read_table(spark, base, "library_items"), read_table(spark, base, "journal_rankings"))
    return mapped.where(mapped.normalized_name == canonical.UNMATCHED).groupBy("raw").count().withColumnRenamed("count", "n_items")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return variants.name_variants(read_table(spark, base, "first_author_affiliations"), read_table(spark, base, "library_items"))


def p2_classes(spark: SparkSession, base: str) -> DataFrame:
    """Every spelling with the class it belongs to: one row for each, where p2_found has one for each pair."""
    return variants.name_classes(read_table(spark, base, "first_author_affiliations"), read_table(spark, base, "library_items"))


P4_KINDS = {"tag": "tags_json", "collection": "collections_json"}


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    pairs = cooccurrence.pair_counts(read_table(spark, base, "library_items"), "item_key", P4_KINDS)
    return pairs.select("kind", "left_value", "right_value")


def p4_pairs(spark: SparkSession, base: str) -> DataFrame:
    """All pairs in five records or more, whatever their lift."""
    pairs = cooccurrence.pair_counts(read_table(spark, base, "library_items"), "item_key", P4_KINDS, min_pairs=5, min_lift=0)
    return pairs.select("kind", "left_value", "right_value", "n_both", "n_left", "n_right", "n_all", F.round("lift", 9).alias("lift"), F.round("pmi", 9).alias("pmi"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return language.language_cases(read_table(spark, base, "library_items")).select("item_key", "seg_no", "language")


def p6_segments(spark: SparkSession, base: str) -> DataFrame:
    """Every stretch of every item, with its confidence."""
    found = language.language_segments(read_table(spark, base, "library_items"))
    return found.select("item_key", "seg_no", "start", "language", F.round("confidence", 4).alias("confidence")).dropDuplicates(["item_key", "seg_no"])


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return ocr.repair_cases(read_table(spark, base, "pdf_extraction"))


def p7_paragraphs(spark: SparkSession, base: str) -> DataFrame:
    return ocr.repaired_paragraphs(read_table(spark, base, "pdf_extraction"))


def p8_containers(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack(read_table(spark, base, "documents"))


def p8_fill(spark: SparkSession, base: str) -> DataFrame:
    """Tokens, pieces and unused space of every container."""
    packed = packing.pack(read_table(spark, base, "documents"))
    filled = packed.groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    return filled.withColumn("unused", F.lit(packing.CAPACITY) - F.col("n_tokens"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    found = contamination.leaked_windows(read_table(spark, base, "documents"), read_table(spark, base, "test_items"))
    return found.select("item_id", "doc_id")


def p9_extent(spark: SparkSession, base: str) -> DataFrame:
    """How many windows of each leaked item a document holds, edits of one unit allowed."""
    return contamination.leaked_windows(read_table(spark, base, "documents"), read_table(spark, base, "test_items"), max_edits=1)


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return spans.shared_spans(read_table(spark, base, "documents"))


def p10_share(spark: SparkSession, base: str) -> DataFrame:
    return spans.shared_share(read_table(spark, base, "documents"))


_P4 = """
    WITH listed AS (
      SELECT DISTINCT kind, item_key, trim(value) AS value FROM (
        SELECT 'tag' AS kind, item_key, unnest(from_json(CASE WHEN json_valid(tags_json) AND json_type(tags_json) = 'ARRAY' THEN tags_json END, '["VARCHAR"]')) AS value FROM library_items
        UNION ALL
        SELECT 'collection', item_key, unnest(from_json(CASE WHEN json_valid(collections_json) AND json_type(collections_json) = 'ARRAY' THEN collections_json END, '["VARCHAR"]')) FROM library_items)
      WHERE trim(value) <> '' AND item_key IS NOT NULL),
    totals AS (SELECT kind, count(DISTINCT item_key) AS n_all FROM listed GROUP BY kind),
    singles AS (SELECT kind, value, count(*) AS n FROM listed GROUP BY kind, value),
    pairs AS (
      SELECT a.kind, a.value AS left_value, b.value AS right_value, count(*) AS n_both
      FROM listed a JOIN listed b ON a.kind = b.kind AND a.item_key = b.item_key AND a.value < b.value GROUP BY ALL HAVING count(*) >= 5),
    full_pairs AS (
      SELECT p.*, x.n AS n_left, y.n AS n_right, n_all FROM pairs p
      JOIN singles x ON x.kind = p.kind AND x.value = left_value
      JOIN singles y ON y.kind = p.kind AND y.value = right_value JOIN totals t ON t.kind = p.kind)
"""

def _plain_sql(text: str) -> str:
    """Case and compatibility forms evened out in DuckDB, which knows no NFKC: a table of single characters made by rule, and the ligatures."""
    forms = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in [*range(0xA0, 0xD800), *range(0xF900, 0x10000)]]
    single = [(a, b) for a, b in forms if a != b and len(b) == 1]
    for wide, narrow in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ß", "ss")):
        text = f"replace({text}, '{wide}', '{narrow}')"
    wide, narrow = ("".join(x).replace("'", "''") for x in zip(*single))
    return f"lower(translate({text}, '{wide}', '{narrow}'))"


# every window of 12 words, or 24 characters, by brute force
_OPENING = "'^(?s)(.*?(?:[.!?]\\s|[。！？]))(.+)$'"
_LETTER = "[\\p{L}\\p{N}]"
_P9 = f"""
    WITH parted AS (SELECT DISTINCT item_id, text, lower(trim(regexp_extract(text, {_OPENING}, 1))) AS opening, regexp_extract(text, {_OPENING}, 2) AS rest FROM test_items WHERE text IS NOT NULL),
    common AS (SELECT opening FROM parted WHERE opening <> '' GROUP BY opening HAVING count(DISTINCT rest) > 1),
    items AS (SELECT item_id, {_plain_sql("CASE WHEN c.opening IS NULL THEN text ELSE rest END")} AS t FROM parted p LEFT JOIN common c ON c.opening = p.opening),
    docs AS (SELECT doc_id, {_plain_sql("text")} AS t FROM documents WHERE text IS NOT NULL),
    kinds AS (SELECT item_id, t, 2 * len(regexp_extract_all(t, '\\p{{Han}}')) > len(regexp_extract_all(t, '{_LETTER}')) AS han FROM items),
    units AS (
      SELECT 'item' AS side, item_id AS id, han, CASE WHEN han THEN regexp_extract_all(t, '{_LETTER}') ELSE regexp_extract_all(t, '{_LETTER}+') END AS u FROM kinds
      UNION ALL SELECT 'doc', doc_id, FALSE, regexp_extract_all(t, '{_LETTER}+') FROM docs
      UNION ALL SELECT 'doc', doc_id, TRUE, regexp_extract_all(t, '{_LETTER}') FROM docs WHERE regexp_matches(t, '\\p{{Han}}')),
    windows AS (SELECT side, id, han, hash(array_to_string(u[k : k + CASE WHEN han THEN 23 ELSE 11 END], ' ')) AS h FROM (SELECT side, id, han, u, unnest(range(1, len(u) - CASE WHEN han THEN 22 ELSE 10 END)) AS k FROM units))
    SELECT DISTINCT i.id AS item_id, d.id AS doc_id FROM windows i JOIN windows d ON i.side = 'item' AND d.side = 'doc' AND i.han = d.han AND i.h = d.h"""

# every window of 240 characters by brute force
_P10 = """
    WITH texts AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 240),
    windows AS (SELECT doc_id, p, hash(substr(text, p + 1, 240)) AS h FROM (SELECT doc_id, text, unnest(range(n - 239)) AS p FROM texts)),
    shared AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) <> max(doc_id)),
    found AS (SELECT doc_id, p FROM windows JOIN shared USING (h)),
    runs AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
      SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 240 THEN 0 ELSE 1 END AS opens FROM found)),
    spans AS (SELECT doc_id, CAST(min(p) AS INTEGER) AS span_start, CAST(max(p) + 240 AS INTEGER) AS span_end FROM runs GROUP BY doc_id, run)
"""

QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_unmatched": p1_unmatched,
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p6_found": p6_found,
    "p6_segments": p6_segments,
    "p7_found": p7_found,
    "p7_paragraphs": p7_paragraphs,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_extent": p9_extent,
    "p10_found": p10_found,
    "p10_share": p10_share,
}

ORACLES: dict[str, str] = {
    "p4_found": _P4 + " SELECT kind, left_value, right_value FROM full_pairs WHERE n_both * n_all >= 4 * n_left * n_right",
    "p4_pairs": _P4
    + """ SELECT kind, left_value, right_value, n_both, n_left, n_right, n_all,
          round(n_both * n_all / (n_left * n_right), 9) AS lift, round(log2(n_both * n_all / (n_left * n_right)), 9) AS pmi FROM full_pairs""",
    "p9_found": _P9,
    "p10_found": _P10 + " SELECT * FROM spans",
    "p10_share": _P10
    + """ SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS INTEGER) AS n_chars, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shared, CASE WHEN coalesce(length(d.text), 0) > 0 THEN coalesce(s.n, 0) / length(d.text) ELSE 0.0 END AS share
      FROM documents d LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS n FROM spans GROUP BY doc_id) s ON s.doc_id = d.doc_id""",
}
