"""Queries that prepare records for packets, plans and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import scalars as S
from marginalia.functions.affiliations import affiliation_of
from marginalia.functions.text import is_known
from marginalia.operators import lookup, search
from marginalia.operators.hierarchy import collection_hierarchy
from marginalia.plans import library
from marginalia.plans.items import _LATEST, _known, latest_items, latest_texts
from marginalia.plans.tags import _TAGS, item_collections, item_tags
from marginalia.sources.tables import read_table


def packet_records(spark: SparkSession, base: str) -> DataFrame:
    """Cards with the state of their text: ok, empty or missing."""
    cards = read_table(spark, base, "first_author_affiliations").where(is_known("zotero_item_key")).select("card_id", F.col("zotero_item_key").alias("item_key")).distinct()
    texts = latest_texts(spark, base).groupBy("item_key").agg(F.max("n_chars").alias("n_chars"))
    joined = cards.join(texts, "item_key", "left")
    state = F.when(F.col("n_chars").isNull(), "missing").when(F.col("n_chars") == 0, "empty").otherwise("ok")
    return joined.select("card_id", "item_key", state.alias("cache_status"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def text_sizes_with_fallback(spark: SparkSession, base: str) -> DataFrame:
    """Text of an attachment by item and attachment, else any text kept for the item alone."""
    texts = latest_texts(spark, base)
    cache = texts.where("status = 'ok' AND method = 'pypdf'").select("item_key", "attachment_key", "n_chars").unionByName(
        texts.where("status = 'ok'").groupBy("item_key").agg(F.max("n_chars").alias("n_chars")).select("item_key", F.lit(None).cast("string").alias("attachment_key"), "n_chars")
    )
    wanted = texts.select("item_key", "attachment_key")
    return lookup.with_fallback(wanted, cache, [["item_key", "attachment_key"], ["item_key"]], "n_chars")


def next_items(spark: SparkSession, base: str) -> DataFrame:
    """The next twenty items of a resumable scan."""
    return lookup.resume_after(search.not_deleted(latest_items(spark, base, ["zotero_deleted"])).select("item_key"), "item_key", "M", 20)


def open_items(spark: SparkSession, base: str) -> DataFrame:
    """Items that no card has done yet."""
    state = read_table(spark, base, "reading_summary").select(
        F.col("zotero_item_key").alias("item_key"), F.lit("").alias("reported_at"), F.when(F.col("阅读状态").isin("read", "已读"), "done").otherwise("").alias("card_status")
    )
    return lookup.unreported(search.not_deleted(latest_items(spark, base, ["zotero_deleted"])).select("item_key"), state, "item_key")


def item_children(spark: SparkSession, base: str) -> DataFrame:
    """Items with their attachments as parallel lists, and the first that holds text."""
    texts = latest_texts(spark, base).select("item_key", "attachment_key", "status", "method")
    lists = texts.groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct("attachment_key", "status", "method"))).alias("c"))
    first = F.get(F.filter(F.col("c"), lambda x: x["status"] == "ok"), F.lit(0))["attachment_key"]
    return lists.select(
        "item_key",
        F.array_join(F.transform("c", lambda x: x["attachment_key"]), "; ").alias("keys"),
        F.array_join(F.transform("c", lambda x: x["status"]), "; ").alias("statuses"),
        F.coalesce(first, F.lit("")).alias("first_ok"),
    )


def extraction_plan(spark: SparkSession, base: str) -> DataFrame:
    """Which attachments would be extracted again if recognition were on."""
    texts = latest_texts(spark, base)
    decide = S.should_extract(F.col("status"), F.col("attachment_key"), F.col("attachment_key"), False, True)
    return texts.select("attachment_key", "status", decide.alias("extract"))


def item_targets(spark: SparkSession, base: str) -> DataFrame:
    """Distinct target paths of each item in the order they were given."""
    rows = latest_items(spark, base, ["collection_paths_json"]).select("item_key", F.posexplode(S.known_strings("collection_paths_json")).alias("pos", "path"))
    return lookup.ordered_lists(rows, "item_key", "path", ["pos"], "paths").select("item_key", F.array_join("paths", " | ").alias("targets"), F.size("paths").alias("n_targets"))


FAMILIES = [("能耗模拟", "Energy"), ("Comfort surveys", "Comfort"), ("热舒适", "Comfort"), ("Radiant systems", "Radiant"), ("辐射供冷", "Radiant")]


def family_rollup(spark: SparkSession, base: str) -> DataFrame:
    """Items and collections per family of collections; collections without a family are Unassigned."""
    families = spark.createDataFrame(FAMILIES, "stem string, family string")
    named = read_table(spark, base, "collections").select(F.trim("collection_key").alias("collection_key"), F.regexp_replace(F.coalesce("name", F.lit("")), r" \d+$", "").alias("stem"))
    keyed = lookup.lookup(named.groupBy("collection_key").agg(F.max("stem").alias("stem")), families, "stem", "family", "Unassigned")
    joined = keyed.join(item_collections(spark, base), "collection_key", "left")
    return joined.groupBy("family").agg(F.count_distinct("collection_key").alias("n_collections"), F.count_distinct("item_key").alias("n_items"))


def year_ranges(spark: SparkSession, base: str) -> DataFrame:
    """First and last year, compared as text, and mean numbers of tags, by item type."""
    items = latest_items(spark, base, ["year", "item_type", "tags_json"])
    return items.groupBy("item_type").agg(
        F.min(F.when(is_known("year"), F.col("year"))).alias("first_year"),
        F.max(F.when(is_known("year"), F.col("year"))).alias("last_year"),
        F.count("*").alias("n_items"),
        F.round(F.avg(F.size(S.known_strings("tags_json"))), 4).alias("tags_per_item"),
    )


def method_shares(spark: SparkSession, base: str) -> DataFrame:
    """Uses of tags per namespace whose value holds any of some hints."""
    tags = item_tags(spark, base)
    hints = {"survey": "survey|questionnaire|interview", "model": "model|solver|simulation", "measurement": "imaging|scan|measurement"}
    return tags.groupBy("namespace").agg(*(F.count_if(F.col("value").rlike(h)).alias(n) for n, h in hints.items()), F.count("*").alias("n_tags"))


def deleted_scopes(spark: SparkSession, base: str) -> DataFrame:
    """Collections that are deleted or lie below one, taking those named 'Old imports' as deleted."""
    tree = collection_hierarchy(read_table(spark, base, "collections")).where("NOT cyclic")
    deleted = tree.where(F.col("path").rlike(r"(^|/)Old imports( \d+)?$")).select("node")
    return lookup.deleted_above(tree, F.col("ancestors"), deleted).select(F.col("node").alias("collection_key"), "deleted")


def name_cells(spark: SparkSession, base: str) -> DataFrame:
    """Parts of names, codes, last segments and paths of links."""
    rows = latest_items(spark, base, ["title", "url"])
    parts = S.name_parts(F.concat_ws("-", "item_key", "title"))
    link = F.concat(F.lit("file:///C:/My%20Files/"), F.col("item_key"), F.lit(".pdf"))
    return rows.select(
        "item_key", parts["code"].alias("code"), F.length(parts["raw"]).alias("size"), S.short_code("title").alias("short"), S.last_segment(F.concat(F.lit("a/b/"), "item_key", F.lit("/"))).alias("segment"),
        S.file_url_path(link).alias("path"), S.clean_section(F.concat(F.lit("?\n  "), S.text_of("title"), F.lit("\n\n?"))).alias("cleaned"),
    )


def affiliation_candidates(spark: SparkSession, base: str) -> DataFrame:
    """The first affiliation on the first page of each text."""
    return read_table(spark, base, "pdf_extraction").where("status = 'ok'").select("attachment_key", affiliation_of(S.first_page("text", 4000)).alias("affiliation")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        packet_records, text_sizes_with_fallback, next_items, open_items, item_children, extraction_plan, item_targets, family_rollup, year_ranges, method_shares, deleted_scopes,
        name_cells, affiliation_candidates,
    )
}

_STEM = "CASE stem " + " ".join(f"WHEN '{s}' THEN '{f}'" for s, f in FAMILIES) + " ELSE 'Unassigned' END"

_PLACES = "(?i)(?:^|[^\\p{L}])(?:university|universität|universidad|université|polytechnic|institute|institut|academy|college|school|faculty|department|laboratory|hospital|centre|center|company|corporation)(?:[^\\p{L}]|$)|大学|学院|研究所|研究院|科学院|实验室|医院|公司"
_OTHERS = "(?i)(?:^|[^\\p{L}])(?:abstract|summary|keywords|key words|doi|received|accepted|published|email|e-mail|phone|copyright)(?:[^\\p{L}]|$)|摘要|关键词|收稿日期|通信作者|作者简介"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace({0}, '^[^\\p{{L}}\\p{{Nd}}]+', ''), '^[a-z0-9][ ,)]+(\\p{{Lu}}|\\p{{Han}})', '\\1'), '[ ,;]+$', '')"

ORACLES = {
    # lines as rows: the first line of a place, then the two behind it up to one that is something else
    "affiliation_candidates": f"""
      WITH page AS (SELECT attachment_key || md5(text) AS k, attachment_key, text, regexp_split_to_array(replace(replace(text, e'\\r\\n', e'\\n'), e'\\r', e'\\n'), '(?m)^===== Page [0-9]+ =====[ \\t]*$') AS parts
        FROM (SELECT DISTINCT attachment_key, text FROM pdf_extraction WHERE status = 'ok')),
      first AS (SELECT k, attachment_key, rtrim(substr(trim(regexp_replace(regexp_replace(CASE WHEN len(parts) > 1 THEN parts[2] ELSE text END, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', e'\\n\\n', 'g'), e' \\t\\n\\r'), 1, 4000), e' \\t\\n\\r') AS t FROM page),
      lined AS (SELECT k, trim(unnest(string_split(t, e'\\n'))) AS line, generate_subscripts(string_split(t, e'\\n'), 1) AS n FROM first),
      kept AS (SELECT k, line, row_number() OVER (PARTITION BY k ORDER BY n) AS no, regexp_matches(line, '{_PLACES}') AS place, regexp_matches(line, '{_OTHERS}') AS other FROM lined WHERE line <> ''),
      begun AS (SELECT k, min(no) AS at_no FROM kept WHERE place AND NOT other AND no <= 120 GROUP BY k),
      near AS (SELECT kept.*, at_no, max(other) OVER (PARTITION BY kept.k ORDER BY no) AS stopped FROM kept JOIN begun ON kept.k = begun.k WHERE no BETWEEN at_no AND least(at_no + 2, 120)),
      whole AS (SELECT k, string_agg({_CLEAN.format("line")}, ', ' ORDER BY no) AS w FROM near WHERE no = at_no OR (NOT stopped AND (place OR regexp_matches(line, '\\b[0-9]{{4,6}}\\b'))) GROUP BY k)
      SELECT DISTINCT attachment_key, coalesce(substr(regexp_replace(w, '[ ,;]+[b-z][ )]\\p{{Lu}}.*$', ''), 1, 300), '') AS affiliation FROM first LEFT JOIN whole ON whole.k = first.k""",
    "packet_records": f"""WITH {_LATEST} SELECT DISTINCT card_id, zotero_item_key AS item_key, CASE WHEN n IS NULL THEN 'missing' WHEN n = 0 THEN 'empty' ELSE 'ok' END AS cache_status, CAST(coalesce(n, 0) AS INTEGER) AS n_chars
      FROM first_author_affiliations LEFT JOIN (SELECT item_key, max(n_chars) AS n FROM texts GROUP BY item_key) x ON x.item_key = zotero_item_key WHERE {_known("zotero_item_key")}""",
    "text_sizes_with_fallback": f"""WITH {_LATEST} SELECT t.item_key, t.attachment_key, CAST(coalesce(CASE WHEN t.status = 'ok' AND t.method = 'pypdf' THEN t.n_chars END, x.n) AS INTEGER) AS n_chars
      FROM texts t LEFT JOIN (SELECT item_key, max(n_chars) AS n FROM texts WHERE status = 'ok' GROUP BY item_key) x ON x.item_key = t.item_key""",
    "next_items": f"WITH {_LATEST} SELECT item_key FROM latest WHERE coalesce(zotero_deleted, 0) = 0 AND item_key > 'M' ORDER BY item_key LIMIT 20",
    "open_items": f"""WITH {_LATEST} SELECT item_key FROM latest WHERE coalesce(zotero_deleted, 0) = 0
      AND item_key NOT IN (SELECT zotero_item_key FROM reading_summary WHERE "阅读状态" IN ('read', '已读') AND zotero_item_key IS NOT NULL)""",
    "item_children": f"""WITH {_LATEST} SELECT item_key, string_agg(attachment_key, '; ' ORDER BY attachment_key) AS keys, string_agg(status, '; ' ORDER BY attachment_key) AS statuses,
      coalesce(min(attachment_key) FILTER (status = 'ok'), '') AS first_ok FROM texts GROUP BY item_key""",
    "extraction_plan": f"WITH {_LATEST} SELECT attachment_key, status, status = 'needs_ocr' AS extract FROM texts",
    "item_targets": f"""WITH {_LATEST}, rows AS (SELECT item_key, unnest(p) AS path, unnest(range(len(p))) AS pos FROM (
        SELECT item_key, list_filter(list_transform(from_json(CASE WHEN json_valid(collection_paths_json) AND json_type(collection_paths_json) = 'ARRAY' THEN collection_paths_json END, '["VARCHAR"]'), lambda x: trim(x)), lambda x: x <> '') AS p FROM latest))
      SELECT item_key, string_agg(path, ' | ' ORDER BY pos) AS targets, CAST(count(*) AS INTEGER) AS n_targets FROM (SELECT item_key, path, min(pos) AS pos FROM rows GROUP BY ALL) GROUP BY item_key""",
    "family_rollup": _TAGS
    + rf""" SELECT family, count(DISTINCT c.collection_key) AS n_collections, count(DISTINCT item_key) AS n_items FROM (SELECT collection_key, {_STEM} AS family FROM (
        SELECT trim(collection_key) AS collection_key, max(regexp_replace(coalesce(name, ''), ' [0-9]+$', '')) AS stem FROM collections GROUP BY 1)) c LEFT JOIN links l ON l.collection_key = c.collection_key GROUP BY family""",
    "year_ranges": f"""WITH {_LATEST} SELECT item_type, min(CASE WHEN {_known("year")} THEN year END) AS first_year, max(CASE WHEN {_known("year")} THEN year END) AS last_year, count(*) AS n_items,
      round(avg(len(tags)), 4) AS tags_per_item FROM latest JOIN listed USING (item_key) GROUP BY item_type""",
    "method_shares": _TAGS
    + """ SELECT namespace, count_if(regexp_matches(value, 'survey|questionnaire|interview')) AS survey, count_if(regexp_matches(value, 'model|solver|simulation')) AS model,
      count_if(regexp_matches(value, 'imaging|scan|measurement')) AS measurement, count(*) AS n_tags FROM tags GROUP BY namespace""",
    "deleted_scopes": library._LATEST + " SELECT node AS collection_key, regexp_matches(path, '(^|/)Old imports( [0-9]+)?(/|$)') AS deleted FROM tree",
    "name_cells": f"""WITH {_LATEST} SELECT item_key, item_key AS code, CAST(length(item_key || '-' || title) AS INTEGER) AS size, coalesce(nullif(substr(regexp_replace(upper(coalesce(title, '')), '[^A-Z0-9]+', '', 'g'), 1, 8), ''), 'UNK') AS short,
      item_key AS segment, 'C:/My Files/' || item_key || '.pdf' AS path, trim(coalesce(title, '')) AS cleaned FROM latest""",
}
