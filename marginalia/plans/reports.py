"""Reports in their orders, mapped values, and plans as rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import scalars as S
from marginalia.functions.text import is_known, known
from marginalia.operators import mapping, orders
from marginalia.plans import cards, tags
from marginalia.plans.items import _LATEST, _known, latest_items


def ranked_collections(spark: SparkSession, base: str) -> DataFrame:
    """Collections by score, then size, then key."""
    return orders.placed(tags.collection_score(spark, base).select("collection_key", "n_items", "score"), orders.by_weight("score", "n_items", then=("collection_key",)))


def ranked_aliases(spark: SparkSession, base: str) -> DataFrame:
    """What becomes of each tag, by namespace and action, the most used first."""
    rows = tags.tag_actions(spark, base).select("namespace", "action", "value", "n")
    return orders.placed(rows, orders.by_group(("namespace", "action"), "n", then=("value",)))


def gated_tags(spark: SparkSession, base: str) -> DataFrame:
    """Method tags with the tag they become: those that are topics are redirected, the long tail is dropped; kept ones come first."""
    rows = tags.tag_actions(spark, base).where("namespace = 'method'")
    canonical = F.when(F.col("action") == "drop_long_tail", "").when(F.col("value").contains("radiant"), F.concat(F.lit("topic/"), "canonical")).otherwise(F.concat(F.lit("method/"), "canonical"))
    gated = rows.select("value", "n", "action", canonical.alias("canonical")).withColumn("gate", mapping.gate(F.col("canonical"), "method/"))
    return orders.placed(gated, [(F.col("action") != "keep").asc(), *orders.by_weight("n", then=("value",))])


def signal_tags(spark: SparkSession, base: str) -> DataFrame:
    """Tags that tell of a survey, the most used first."""
    rows = mapping.signals(tags.tag_actions(spark, base).select("namespace", "value", "n"), "value", "survey")
    return orders.placed(rows, orders.by_weight("n", then=("namespace", "value")))


def newest_items(spark: SparkSession, base: str) -> DataFrame:
    return orders.placed(latest_items(spark, base, ["date_added"]).select("item_key", "date_added"), orders.newest_first("date_added", "item_key"))


def missing_path_order(spark: SparkSession, base: str) -> DataFrame:
    """Missing paths in the order in which they can be made."""
    return orders.placed(tags.missing_paths(spark, base).select("path"), orders.shallow_first("path"))


def summary_order(spark: SparkSession, base: str) -> DataFrame:
    rows = cards.summary_rows(spark, base).select("card_id", "title")
    return orders.placed(rows, orders.by_number(F.regexp_extract("card_id", r"(\d+)$", 1), "card_id"))


def ranked_paths(spark: SparkSession, base: str) -> DataFrame:
    """Paths by their topmost part, within it those of most items first."""
    rows = tags.path_rollup(spark, base).withColumn("top", F.substring_index("path", "/", 1))
    return orders.placed(rows, orders.by_group(("top",), "n_items", then=("path",)))


def dictionary_order(spark: SparkSession, base: str) -> DataFrame:
    return orders.placed(cards.rank_dictionary(spark, base).select("normalized_name", "journal_name"), orders.by_name("journal_name", "normalized_name"))


def viewer_order(spark: SparkSession, base: str) -> DataFrame:
    """The summary as a page sorts it by year."""
    return orders.placed(cards.summary_rows(spark, base).select("card_id", "year"), orders.as_shown("year", "card_id"))


def rule_confidence(spark: SparkSession, base: str) -> DataFrame:
    """Items that each rule takes, and the mean share that the rule has in all the rules an item meets."""
    hits = tags.classified_items(spark, base)
    shares = hits.join(hits.groupBy("item_key").agg((1 / F.count("*")).alias("confidence")), "item_key")
    return mapping.group_means(shares, ["rule_group", "rule_name"], "confidence")


def survey_rates(spark: SparkSession, base: str) -> DataFrame:
    """Uses of survey tags for each item of a collection."""
    hits = tags.item_tags(spark, base).where(F.col("value").contains("survey"))
    return mapping.hit_rates(tags.item_collections(spark, base), hits, "item_key", "collection_key").withColumn("rate", F.round("rate", 9))


#: Tags of item types.
TYPE_TAGS = {
    "journalArticle": "#Type/JournalArticle", "thesis": "#Type/Thesis", "book": "#Type/Book", "standard": "#Type/Standard", "conferencePaper": "#Type/ConferencePaper", "webpage": "#Type/Webpage",
    "report": "#Type/Report", "bookSection": "#Type/BookSection", "computerProgram": "#Type/Software", "patent": "#Type/Patent", "newspaperArticle": "#Type/NewsArticle", "document": "#Type/Document",
}


def type_tags(spark: SparkSession, base: str) -> DataFrame:
    rows = latest_items(spark, base, ["item_type"])
    return rows.select("item_key", mapping.mapped(F.col("item_type"), TYPE_TAGS, "#Type/Document").alias("tag"))


READING = [("已读", "done"), ("skim", "partly"), ("to_", "open")]


def reading_degrees(spark: SparkSession, base: str) -> DataFrame:
    """The reading status by the word it holds, unknown ones by the card's first tag."""
    rows = cards.summary_rows(spark, base)
    first = F.get(S.split_list("tags", ";,|"), F.lit(0))
    return rows.select("card_id", F.coalesce(mapping.first_containing(F.col("read_status"), READING), first, F.lit("")).alias("degree"))


def topic_cells(spark: SparkSession, base: str) -> DataFrame:
    """Topic codes in list cells, one label for each code; the cells number each card's tags by threes."""
    rows = cards.summary_rows(spark, base)
    numbered = F.transform(S.split_list("tags", ";,|"), lambda v, i: F.concat(F.lit("T"), (i % 3 + 1).cast("string"), F.lit("_"), v))
    found = rows.select("card_id", F.explode(mapping.topic_codes(F.array_join(numbered, "; "))).alias("t"))
    return found.select("card_id", "t.code", "t.label")


SCREENING = {"read_status": {"read": "status/read", "已读": "status/read", "to_read": "status/todo"}, "year": {str(y): "period/recent" for y in range(2015, 2025)}}


def screening_tags(spark: SparkSession, base: str) -> DataFrame:
    """Tags of a card's status and year, and what the tables don't know."""
    found = mapping.mapped_with_warnings(cards.summary_rows(spark, base), "card_id", SCREENING)
    return found.select("card_id", F.array_join("tags", "; ").alias("tags"), F.array_join("warnings", "; ").alias("warnings"))


def mirror_actions(spark: SparkSession, base: str) -> DataFrame:
    """A tagging action for each card with an item and with tags; nothing is carried out."""
    found = mapping.mapped_with_warnings(cards.summary_rows(spark, base), "card_id", SCREENING).join(cards.summary_rows(spark, base).select("card_id", "item_key"), "card_id")
    plan = mapping.action_documents(found.withColumn("key", known("item_key")), "key", "add_tags", {"tags": F.col("tags")}, F.size("tags") > 0)
    return plan.groupBy("key", "document").agg(F.count("*").alias("n_cards"))


def _sides(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Items as they are, and as they would be with unknown abbreviations filled by the publication."""
    rows = latest_items(spark, base, ["publication", "journal_abbreviation"]).select("item_key", "version", "publication", "journal_abbreviation")
    filled = F.when(is_known("journal_abbreviation"), F.col("journal_abbreviation")).otherwise(F.col("publication"))
    return rows, rows.withColumn("journal_abbreviation", filled)


def audit_rows(spark: SparkSession, base: str) -> DataFrame:
    """Before and after of the items that filling the abbreviations would change."""
    return mapping.audit(*_sides(spark, base), "item_key", ["journal_abbreviation"])


def inverse_plan(spark: SparkSession, base: str) -> DataFrame:
    """What undoes that change."""
    return mapping.inverse(*_sides(spark, base), "item_key", ["version", "journal_abbreviation"])


def overlaid_metadata(spark: SparkSession, base: str) -> DataFrame:
    """Cards' metadata with the summary's values laid over them: keys that only one side has stay."""
    own = cards.card_rows(spark, base).select("card_id", F.create_map(F.lit("status"), S.text_of("first_author_affiliation_status"), F.lit("item"), S.text_of("zotero_item_key")).alias("old"))
    fresh = cards.summary_rows(spark, base).select("card_id", F.create_map(F.lit("status"), S.text_of("read_status"), F.lit("year"), S.text_of("year")).alias("new"))
    merged = own.join(fresh, "card_id").select("card_id", "old", mapping.overlay(F.col("old"), F.col("new")).alias("m"))
    return merged.select("card_id", *(F.col("m")[k].alias(k) for k in ("item", "status", "year")), (F.col("old")["status"] != F.col("m")["status"]).alias("changed"))


QUERIES = {
    f.__name__: f
    for f in (
        ranked_collections, ranked_aliases, gated_tags, signal_tags, newest_items, missing_path_order, summary_order, ranked_paths, dictionary_order, viewer_order, rule_confidence, survey_rates,
        type_tags, reading_degrees, topic_cells, screening_tags, mirror_actions, audit_rows, inverse_plan, overlaid_metadata,
    )
}


def _place(inner: str, order: str, columns: str = "*") -> str:
    return f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS place FROM ({inner})"


_SIDES = (
    "WITH "
    + _LATEST.rstrip().rstrip(",")
    + f", changed AS (SELECT item_key, version, journal_abbreviation, publication FROM latest WHERE NOT {_known('journal_abbreviation')} AND journal_abbreviation IS DISTINCT FROM publication)"
)
_CANONICAL = "CASE WHEN action = 'drop_long_tail' THEN '' WHEN contains(value, 'radiant') THEN 'topic/' || canonical ELSE 'method/' || canonical END"
_TYPE = "CASE item_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_TAGS.items()) + " ELSE '#Type/Document' END"
_SUMMARY = "WITH " + cards._SUMMARY
_LISTED = cards._SPLIT.format("tags", ";,|")
_STATUS = "CASE trim(coalesce(read_status, '')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SCREENING["read_status"].items()) + " END"
_YEAR = "CASE WHEN trim(coalesce(year, '')) IN (" + ", ".join(f"'{y}'" for y in SCREENING["year"]) + ") THEN 'period/recent' END"
_SCREENED = f"""screened AS (SELECT card_id, item_key, list_filter([{_STATUS}, {_YEAR}], lambda x: x IS NOT NULL) AS tags,
      list_filter([CASE WHEN {_known("read_status")} AND {_STATUS} IS NULL THEN 'read_status: ' || trim(read_status) END, CASE WHEN {_known("year")} AND {_YEAR} IS NULL THEN 'year: ' || trim(year) END], lambda x: x IS NOT NULL) AS warnings FROM summary)"""

ORACLES = {
    "ranked_collections": _place(tags.ORACLES["collection_score"], "score DESC, n_items DESC, collection_key", "collection_key, n_items, score"),
    "ranked_aliases": _place(tags.ORACLES["tag_actions"], "namespace, action, n DESC, value", "namespace, action, value, n"),
    "gated_tags": f"SELECT value, n, action, canonical, CASE WHEN starts_with(canonical, 'method/') THEN 'pass' WHEN canonical <> '' THEN 'redirect' ELSE 'drop' END AS gate, row_number() OVER (ORDER BY action <> 'keep', n DESC, value) AS place FROM (SELECT value, n, action, {_CANONICAL} AS canonical FROM ({tags.ORACLES['tag_actions']}) WHERE namespace = 'method')",
    "signal_tags": _place(f"SELECT namespace, value, n FROM ({tags.ORACLES['tag_actions']}) WHERE contains(regexp_replace(lower(value), '[^a-z0-9]+', '', 'g'), 'survey')", "n DESC, namespace, value"),
    "newest_items": "WITH " + _LATEST.rstrip().rstrip(",") + " SELECT item_key, date_added, row_number() OVER (ORDER BY date_added DESC NULLS LAST, item_key DESC) AS place FROM latest",
    "missing_path_order": _place(tags.ORACLES["missing_paths"], "len(string_split(path, '/')), path", "path"),
    "summary_order": _SUMMARY + " SELECT card_id, title, row_number() OVER (ORDER BY coalesce(TRY_CAST(regexp_extract(card_id, '([0-9]+)$', 1) AS BIGINT), 0), card_id) AS place FROM summary",
    "ranked_paths": _place(f"SELECT path, n_items, string_split(path, '/')[1] AS top FROM ({tags.ORACLES['path_rollup']})", "top, n_items DESC, path"),
    "dictionary_order": _SUMMARY + " SELECT normalized_name, journal_name, row_number() OVER (ORDER BY lower(journal_name) NULLS FIRST, normalized_name) AS place FROM dictionary",
    "viewer_order": _SUMMARY + " SELECT card_id, year, row_number() OVER (ORDER BY TRY_CAST(year AS DOUBLE) NULLS LAST, lower(coalesce(year, '')), card_id) AS place FROM summary",
    "rule_confidence": f"SELECT rule_group, rule_name, count(*) AS n, round(avg(1.0::DOUBLE / k), 4) AS mean FROM (SELECT *, count(*) OVER (PARTITION BY item_key) AS k FROM ({tags.ORACLES['classified_items']})) GROUP BY ALL",
    "survey_rates": f"""SELECT l.collection_key, count(DISTINCT l.item_key) AS n, CAST(coalesce(sum(h.k), 0) AS BIGINT) AS n_hits, round(coalesce(sum(h.k), 0) / count(DISTINCT l.item_key), 9) AS rate FROM ({tags.ORACLES["item_collections"]}) l
      LEFT JOIN (SELECT item_key, count(*) AS k FROM ({tags.ORACLES["item_tags"]}) WHERE contains(value, 'survey') GROUP BY item_key) h ON h.item_key = l.item_key GROUP BY l.collection_key""",
    "type_tags": "WITH " + _LATEST.rstrip().rstrip(",") + f" SELECT item_key, {_TYPE} AS tag FROM latest",
    "reading_degrees": _SUMMARY
    + f""" SELECT card_id, coalesce(CASE WHEN NOT {_known("read_status")} THEN NULL {" ".join(f"WHEN contains(read_status, '{w}') THEN '{v}'" for w, v in READING)} ELSE trim(read_status) END,
      CASE WHEN {_known("tags")} THEN {_LISTED}[1] END, '') AS degree FROM summary""",
    "topic_cells": _SUMMARY
    + f""", cells AS (SELECT card_id, {_LISTED} AS v FROM summary WHERE {_known("tags")}), numbered AS (SELECT card_id, unnest(v) AS value, generate_subscripts(v, 1) AS i FROM cells)
      SELECT card_id, 'T' || (i - 1) % 3 + 1 AS code, 'T' || ((i - 1) % 3 + 1) || '_' || trim(regexp_extract(value, '^[^;|,，、]*'), e' \\t\\n\\r') AS label FROM numbered WHERE i <= 3""".replace("'T' || (i - 1) % 3 + 1 AS code", "'T' || ((i - 1) % 3 + 1) AS code"),
    "screening_tags": _SUMMARY + "," + _SCREENED + " SELECT card_id, array_to_string(tags, '; ') AS tags, array_to_string(warnings, '; ') AS warnings FROM screened",
    "mirror_actions": _SUMMARY
    + ","
    + _SCREENED
    + f""", made AS (SELECT trim(item_key) AS key, '{{"key":"' || trim(item_key) || '","action":"add_tags","tags":["' || array_to_string(tags, '","') || '"]}}' AS document FROM screened WHERE {_known("item_key")} AND len(tags) > 0)
      SELECT key, document, count(*) AS n_cards FROM made GROUP BY ALL""",
    "audit_rows": _SIDES
    + " SELECT item_key, to_json(struct_pack(journal_abbreviation := journal_abbreviation))::VARCHAR AS before, to_json(struct_pack(journal_abbreviation := publication))::VARCHAR AS after FROM changed",
    "inverse_plan": _SIDES + " SELECT item_key, version, journal_abbreviation FROM changed",
    "overlaid_metadata": _SUMMARY
    + """ SELECT c.card_id, coalesce(c.zotero_item_key, '') AS item, coalesce(s.read_status, '') AS status, coalesce(s.year, '') AS year, coalesce(first_author_affiliation_status, '') <> coalesce(s.read_status, '') AS changed
      FROM cards c JOIN summary s ON s.card_id = c.card_id""",
}
