"""Queries over items and their attachments' texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import scalars as S
from marginalia.functions.text import is_known, journal_key, known, trim_ws
from marginalia.operators import aggregate, merge, search
from marginalia.sources.tables import read_table

ITEM_COLUMNS = [
    "item_key", "version", "item_type", "title", "creators_json", "year", "date", "publication", "journal_abbreviation", "doi", "language",
    "abstract_note", "collections_json", "collection_paths_json", "tags_json", "date_added", "date_modified", "first_seen_at", "last_seen_at", "last_synced_at", "zotero_deleted",
]


def latest_items(spark: SparkSession, base: str, columns: list[str]) -> DataFrame:
    """The newest row of every item, only the columns that are asked for."""
    wanted = list(dict.fromkeys(["item_key", "version", "last_synced_at", *columns]))
    return merge.last_rows(read_table(spark, base, "library_items").select(*wanted), ["item_key"], ["version", "last_synced_at"])


def latest_texts(spark: SparkSession, base: str) -> DataFrame:
    """(attachment_key, item_key, status, n_chars, pages_total): one row per attachment, without the text itself."""
    rows = read_table(spark, base, "pdf_extraction").select(
        "attachment_key", "item_key", "status", "method", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), "pages_total", "pages_with_text", "extracted_at"
    )
    return merge.last_rows(rows, ["attachment_key"], ["extracted_at"])


def items_latest(spark: SparkSession, base: str) -> DataFrame:
    return latest_items(spark, base, ["title", "item_type", "zotero_deleted"]).select("item_key", "version", "item_type", "title", "zotero_deleted")


SEARCH_COLUMNS = ["title", "abstract_note", "publication", "creators_json", "tags_json"]


def search_items(spark: SparkSession, base: str) -> DataFrame:
    """Items that mention radiant panels anywhere, with their authors, in context order."""
    items = latest_items(spark, base, [*SEARCH_COLUMNS, "year", "zotero_deleted"])
    hits = search.search(items, "Radiant Panel", SEARCH_COLUMNS)
    return hits.select("item_key", "year", "title", S.creators_text("creators_json").alias("creators")).orderBy(*search.context_order())


def search_first(spark: SparkSession, base: str) -> DataFrame:
    """The first 50 of a search: the report's limit is the feature."""
    return search_items(spark, base).limit(50)


def item_records(spark: SparkSession, base: str) -> DataFrame:
    """Compact records of literature items: venue cascade, year, author text, citation label, tags."""
    items = search.not_deleted(latest_items(spark, base, ITEM_COLUMNS)).where(~F.col("item_type").isin(search.CHILD_TYPES))
    creators = S.creators_text("creators_json")
    return items.select(
        "item_key",
        "item_type",
        trim_ws(S.text_of("title")).alias("title"),
        creators.alias("creators"),
        S.year_of("date").alias("year_of_date"),
        S.first_known("publication", "journal_abbreviation").alias("venue"),
        S.citation_label(creators, "year").alias("citation"),
        F.array_join(S.known_strings("tags_json"), "; ").alias("tags"),
        F.size(S.known_strings("collections_json")).alias("n_collections"),
        is_known("abstract_note").alias("has_abstract"),
        S.item_link("item_key", "library").alias("link"),
    )


def scalar_cells(spark: SparkSession, base: str) -> DataFrame:
    """Cell functions side by side."""
    items = latest_items(spark, base, ["title", "publication", "url", "date"])
    return items.select(
        "item_key",
        S.slug("title").alias("slug"),
        S.compact_token("title").alias("token"),
        S.display_width("title").alias("width"),
        journal_key(S.text_of("publication")).alias("venue_key"),
        S.html_escape("publication").alias("escaped"),
        S.item_key(F.concat(F.lit("library://select/items/"), F.lower("item_key"))).alias("key_of_link"),
        S.normalize_scalar("publication").alias("plain"),
    )


def library_summary(spark: SparkSession, base: str) -> DataFrame:
    """Scalar counts of the whole library as (measure, value): one pass over each table."""
    items = latest_items(spark, base, ["item_type", "abstract_note", "tags_json", "zotero_deleted", "doi"]).agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col("zotero_deleted") == 1).alias("n_deleted"),
        F.count_if(is_known("abstract_note")).alias("n_abstracts"),
        F.count_if(F.size(S.known_strings("tags_json")) > 0).alias("n_tagged"),
        F.count_distinct("item_type").alias("n_types"),
        F.count_if(is_known("doi")).alias("n_dois"),
    )
    texts = latest_texts(spark, base).agg(
        F.count("*").alias("n_attachments"),
        F.count_if(F.col("status") == "ok").alias("n_ok"),
        F.count_if(F.col("status") == "needs_ocr").alias("n_needs_ocr"),
        F.count_if(F.col("status") == "error").alias("n_errors"),
        F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("n_chars"),
        F.coalesce(F.sum("pages_total"), F.lit(0)).cast("long").alias("n_pages"),
    )
    counts = [df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("value")) for c in df.columns))).alias("m")) for df in (items, texts)]
    return counts[0].union(counts[1]).select("m.measure", "m.value")


def pending_texts(spark: SparkSession, base: str) -> DataFrame:
    """Items without any text row."""
    return search.not_deleted(latest_items(spark, base, ["zotero_deleted"])).select("item_key").join(latest_texts(spark, base).select("item_key"), "item_key", "left_anti")


def ocr_queue(spark: SparkSession, base: str) -> DataFrame:
    """Attachments to recognise, in queue order."""
    items = latest_items(spark, base, ["item_type"]).select("item_key", "item_type")
    queue = latest_texts(spark, base).where("status = 'needs_ocr'").join(items, "item_key", "left")
    return queue.where(search.needs_ocr(queue, ["thesis"], 80)).select("item_key", "attachment_key", "pages_total", "item_type").orderBy("item_key", "attachment_key")


def ocr_counts(spark: SparkSession, base: str) -> DataFrame:
    items = latest_items(spark, base, ["item_type"]).select("item_key", "item_type")
    texts = latest_texts(spark, base).where("status = 'needs_ocr'").join(items, "item_key", "left")
    return texts.agg(F.count("*").alias("n_candidates"), F.count_if(search.needs_ocr(texts, ["thesis"], 80)).alias("n_eligible"))


def best_text(spark: SparkSession, base: str) -> DataFrame:
    return search.best_text(latest_texts(spark, base).select("item_key", "attachment_key", "status", "n_chars").where("item_key IS NOT NULL"))


def item_text_links(spark: SparkSession, base: str) -> DataFrame:
    """Items with their texts, ordered by status, length and key; items without texts stay."""
    texts = search.ranked_texts(latest_texts(spark, base).select("item_key", "attachment_key", "status", "n_chars"))
    items = latest_items(spark, base, ["title"]).select("item_key", "title")
    return items.join(texts, "item_key", "left").select("item_key", "title", "place", "attachment_key", "status", "n_chars")


def unextracted_flags(spark: SparkSession, base: str) -> DataFrame:
    """Per item: has it an attachment that isn't extracted?"""
    flags = latest_texts(spark, base).groupBy("item_key").agg(F.bool_or(F.col("status") != "ok").alias("waiting"), F.count("*").alias("n_attachments"))
    items = latest_items(spark, base, []).select("item_key")
    return items.join(flags, "item_key", "left").select("item_key", F.coalesce("waiting", F.lit(False)).alias("waiting"), F.coalesce("n_attachments", F.lit(0)).alias("n_attachments"))


def corpus_records(spark: SparkSession, base: str) -> DataFrame:
    """Three-way join of items, their tags and their texts, with presence flags."""
    items = search.not_deleted(latest_items(spark, base, ["title", "abstract_note", "tags_json", "zotero_deleted", "item_type"]))
    texts = latest_texts(spark, base).groupBy("item_key").agg(F.count_if(F.col("status") == "ok").alias("n_texts"), F.sum("n_chars").alias("n_chars"))
    joined = items.join(texts, "item_key", "left")
    return joined.select(
        "item_key",
        "item_type",
        is_known("abstract_note").alias("has_abstract"),
        (F.size(S.known_strings("tags_json")) > 0).alias("has_tags"),
        (F.coalesce("n_texts", F.lit(0)) > 0).alias("has_text"),
        F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"),
        F.size(S.known_strings("tags_json")).alias("n_tags"),
    )


def corpus_coverage(spark: SparkSession, base: str) -> DataFrame:
    """Coverage by item type."""
    return corpus_records(spark, base).groupBy("item_type").agg(
        F.count("*").alias("n_items"),
        F.count_if("has_abstract").alias("n_abstract"),
        F.count_if("has_tags").alias("n_tags"),
        F.count_if("has_text").alias("n_text"),
        F.avg(F.col("has_abstract").cast("double")).alias("abstract_rate"),
    )


def field_profile(spark: SparkSession, base: str) -> DataFrame:
    columns = ["title", "creators_json", "year", "publication", "doi", "isbn", "url", "language", "abstract_note", "tags_json"]
    return aggregate.profile(read_table(spark, base, "library_items").select(*columns), columns, is_known)


def duplicate_items(spark: SparkSession, base: str) -> DataFrame:
    """Groups of items with the same DOI, or the same title apart from case and signs."""
    items = latest_items(spark, base, ["doi", "title"])
    keys = items.select(
        "item_key",
        F.explode(
            F.array(
                F.struct(F.lit("doi").alias("reason"), F.lower(known("doi")).alias("value")),
                F.struct(F.lit("title").alias("reason"), journal_key(known("title")).alias("value")),
            )
        ).alias("k"),
    ).where("k.value <> ''")
    return keys.groupBy("k.reason", "k.value").agg(F.count("*").alias("n_items"), F.min("item_key").alias("first_key")).where("n_items > 1")


def missing_keys(spark: SparkSession, base: str) -> DataFrame:
    """Keys that other tables name and the items lack."""
    named = (
        read_table(spark, base, "item_events").select("item_key")
        .union(read_table(spark, base, "pdf_extraction").select("item_key"))
        .union(read_table(spark, base, "reading_summary").select(F.col("zotero_item_key").alias("item_key")))
        .where(is_known("item_key"))
        .distinct()
    )
    return named.join(latest_items(spark, base, []).select("item_key"), "item_key", "left_anti")


def column_widths(spark: SparkSession, base: str) -> DataFrame:
    """Width of each column of a table on a page, in pixels, between 60 and 480."""
    rows = read_table(spark, base, "reading_summary")
    widths = rows.agg(*(F.least(F.greatest(F.max(S.display_width(c)) * 8 + 16, F.lit(60)), F.lit(480)).alias(c) for c in ("题目", "作者", "期刊/来源", "Tags")))
    return widths.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("width_px")) for c in widths.columns))).alias("w")).select("w.field", "w.width_px")


def request_lines(spark: SparkSession, base: str) -> DataFrame:
    """One JSON request line per item for a batch service."""
    items = search.not_deleted(latest_items(spark, base, ["title", "abstract_note", "zotero_deleted"])).where(is_known("abstract_note"))
    body = F.struct(F.lit("classify").alias("task"), S.text_of("title").alias("title"), F.length("abstract_note").alias("size"))
    return items.select("item_key", F.to_json(F.struct(F.col("item_key").alias("custom_id"), body.alias("body"))).alias("line"))


def request_results(spark: SparkSession, base: str) -> DataFrame:
    """Request lines read back: nested JSON with an error class per line."""
    lines = request_lines(spark, base)
    parsed = F.from_json("line", "custom_id string, body struct<task:string, title:string, size:int>")
    return lines.select(
        parsed["custom_id"].alias("item_key"),
        parsed["body"]["size"].alias("size"),
        F.when(parsed["custom_id"].isNull(), "no_id").when(parsed["body"].isNull(), "no_body").when(parsed["body"]["title"] == "", "no_title").otherwise("").alias("error"),
    )


_LATEST = """
    latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY version DESC NULLS LAST, last_synced_at DESC NULLS LAST) AS newest FROM library_items) WHERE newest = 1),
    texts AS (SELECT attachment_key, item_key, status, method, coalesce(length(text), 0) AS n_chars, pages_total, pages_with_text, extracted_at FROM (
      SELECT *, row_number() OVER (PARTITION BY attachment_key ORDER BY extracted_at DESC NULLS LAST) AS newest FROM pdf_extraction) WHERE newest = 1),
    listed AS (SELECT item_key, list_filter(list_transform(coalesce(from_json(CASE WHEN json_valid(tags_json) AND json_type(tags_json) = 'ARRAY' THEN tags_json END, '["VARCHAR"]'), []), lambda x: trim(x)), lambda x: x <> '') AS tags,
                      list_filter(list_transform(coalesce(from_json(CASE WHEN json_valid(collections_json) AND json_type(collections_json) = 'ARRAY' THEN collections_json END, '["VARCHAR"]'), []), lambda x: trim(x)), lambda x: x <> '') AS collections FROM latest)
"""
_KNOWN = "coalesce(lower(trim({0}, e' \\t\\n\\r')) NOT IN ('', '?', '[]', 'none', 'null', '未填写'), FALSE)"


def _known(x: str) -> str:
    return _KNOWN.format(x)


_CREATORS = """
    people AS (
      SELECT item_key, coalesce(string_agg(name, '; ' ORDER BY place), '') AS creators FROM (
        SELECT item_key, place, CASE WHEN coalesce(json_extract_string(c, '$.name'), '') <> '' THEN trim(json_extract_string(c, '$.name'))
                 ELSE trim(coalesce(json_extract_string(c, '$.firstName'), '') || ' ' || coalesce(json_extract_string(c, '$.lastName'), '')) END AS name
        FROM (SELECT item_key, unnest(json_extract(creators_json, '$[*]')) AS c, unnest(range(json_array_length(creators_json)::BIGINT)) AS place FROM latest WHERE json_valid(creators_json)))
      WHERE name <> '' GROUP BY item_key)
"""

QUERIES = {
    f.__name__: f
    for f in (
        items_latest, search_items, search_first, item_records, scalar_cells, library_summary, pending_texts, ocr_queue, ocr_counts, best_text, item_text_links,
        unextracted_flags, corpus_records, corpus_coverage, field_profile, duplicate_items, missing_keys, column_widths, request_lines, request_results,
    )
}

_SEARCH = (
    "WITH "
    + _LATEST
    + ","
    + _CREATORS
    + """
    SELECT l.item_key, l.year, l.title, coalesce(p.creators, '') AS creators FROM latest l LEFT JOIN people p ON p.item_key = l.item_key
    WHERE coalesce(zotero_deleted, 0) = 0 AND (contains(lower(coalesce(title, '')), 'radiant panel') OR contains(lower(coalesce(abstract_note, '')), 'radiant panel')
      OR contains(lower(coalesce(publication, '')), 'radiant panel') OR contains(lower(coalesce(creators_json, '')), 'radiant panel') OR contains(lower(coalesce(tags_json, '')), 'radiant panel'))
    ORDER BY l.year DESC NULLS LAST, lower(l.title) NULLS FIRST, l.item_key"""
)
_CORPUS = f"""
    corpus AS (
      SELECT l.item_key, l.item_type, {_known("abstract_note")} AS has_abstract, len(t.tags) > 0 AS has_tags, coalesce(x.n_texts, 0) > 0 AS has_text,
             CAST(coalesce(x.n_chars, 0) AS BIGINT) AS n_chars, CAST(len(t.tags) AS INTEGER) AS n_tags
      FROM latest l JOIN listed t ON t.item_key = l.item_key
      LEFT JOIN (SELECT item_key, count_if(status = 'ok') AS n_texts, sum(n_chars) AS n_chars FROM texts GROUP BY item_key) x ON x.item_key = l.item_key
      WHERE coalesce(zotero_deleted, 0) = 0)
"""

ORACLES = {
    "request_lines": f"""WITH {_LATEST.rstrip().rstrip(",")}
      SELECT item_key, json_object('custom_id', item_key, 'body', json_object('task', 'classify', 'title', coalesce(title, ''), 'size', length(abstract_note)))::VARCHAR AS line
      FROM latest WHERE coalesce(zotero_deleted, 0) = 0 AND {_known("abstract_note")}""",
    "items_latest": "WITH " + _LATEST + " SELECT item_key, version, item_type, title, zotero_deleted FROM latest",
    "search_items": _SEARCH,
    "search_first": _SEARCH + " LIMIT 50",
    "item_records": "WITH "
    + _LATEST
    + ","
    + _CREATORS
    + rf"""
    SELECT l.item_key, item_type, trim(coalesce(title, ''), e' \t\n\r') AS title, coalesce(p.creators, '') AS creators,
      CASE WHEN len(list_filter(regexp_split_to_array(coalesce(date, ''), '[-/.]'), lambda x: regexp_full_match(x, '[0-9]{{4}}'))) > 0
           THEN list_filter(regexp_split_to_array(coalesce(date, ''), '[-/.]'), lambda x: regexp_full_match(x, '[0-9]{{4}}'))[1]
           WHEN regexp_matches(coalesce(date, ''), '^[0-9]{{4}}') THEN substr(date, 1, 4) ELSE '' END AS year_of_date,
      coalesce(CASE WHEN {_known("publication")} THEN trim(publication) END, CASE WHEN {_known("journal_abbreviation")} THEN trim(journal_abbreviation) END, '') AS venue,
      coalesce(nullif(string_split(trim(string_split(coalesce(p.creators, ''), ';')[1]), ' ')[-1], ''), 'Unknown') || '(' || coalesce(nullif(year, ''), 'n.d.') || ')' AS citation,
      array_to_string(t.tags, '; ') AS tags, CAST(len(t.collections) AS INTEGER) AS n_collections, {_known("abstract_note")} AS has_abstract,
      '[' || l.item_key || '](library://select/library/items/' || l.item_key || ')' AS link
    FROM latest l JOIN listed t ON t.item_key = l.item_key LEFT JOIN people p ON p.item_key = l.item_key
    WHERE coalesce(zotero_deleted, 0) = 0 AND item_type NOT IN ('attachment', 'note', 'annotation')""",
    "scalar_cells": "WITH "
    + _LATEST
    + r"""
    SELECT item_key, coalesce(nullif(trim(regexp_replace(lower(trim(coalesce(title, ''))), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unclassified') AS slug,
      regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '', 'g') AS token,
      CAST(length(coalesce(title, '')) + length(regexp_replace(coalesce(title, ''), '[\x00-\x7F]', '', 'g')) AS INTEGER) AS width,
      regexp_replace(lower(coalesce(publication, '')), '[^\p{L}\p{N}_]+', '', 'g') AS venue_key,
      replace(replace(replace(replace(coalesce(publication, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
      item_key AS key_of_link, lower(trim(coalesce(publication, ''), e' \t\n\r')) AS plain FROM latest""",
    "library_summary": "WITH "
    + _LATEST
    + f"""
    SELECT unnest(['n_items', 'n_deleted', 'n_abstracts', 'n_types', 'n_dois']) AS measure,
      unnest([count(*), count_if(zotero_deleted = 1), count_if({_known("abstract_note")}), count(DISTINCT item_type), count_if({_known("doi")})])::BIGINT AS value FROM latest
    UNION ALL SELECT 'n_tagged', count_if(len(tags) > 0) FROM listed
    UNION ALL SELECT unnest(['n_attachments', 'n_ok', 'n_needs_ocr', 'n_errors', 'n_chars', 'n_pages']),
      unnest([count(*), count_if(status = 'ok'), count_if(status = 'needs_ocr'), count_if(status = 'error'), coalesce(sum(n_chars), 0), coalesce(sum(pages_total), 0)])::BIGINT FROM texts""",
    "pending_texts": "WITH " + _LATEST + " SELECT item_key FROM latest WHERE coalesce(zotero_deleted, 0) = 0 AND item_key NOT IN (SELECT item_key FROM texts WHERE item_key IS NOT NULL)",
    "ocr_queue": "WITH "
    + _LATEST
    + """ SELECT t.item_key, t.attachment_key, t.pages_total, l.item_type FROM texts t LEFT JOIN latest l ON l.item_key = t.item_key
      WHERE t.status = 'needs_ocr' AND coalesce(l.item_type, '') <> 'thesis' AND coalesce(t.pages_total, 0) <= 80""",
    "ocr_counts": "WITH "
    + _LATEST
    + """ SELECT count(*) AS n_candidates, count_if(coalesce(l.item_type, '') <> 'thesis' AND coalesce(t.pages_total, 0) <= 80) AS n_eligible
      FROM texts t LEFT JOIN latest l ON l.item_key = t.item_key WHERE t.status = 'needs_ocr'""",
    "best_text": "WITH "
    + _LATEST
    + """ SELECT item_key, attachment_key, status, CAST(n_chars AS INTEGER) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY item_key
      ORDER BY CASE status WHEN 'ok' THEN 0 WHEN 'needs_ocr' THEN 1 WHEN 'missing' THEN 2 ELSE 3 END, n_chars DESC, attachment_key) AS place FROM texts WHERE item_key IS NOT NULL) WHERE place = 1""",
    "item_text_links": "WITH "
    + _LATEST
    + """ SELECT l.item_key, l.title, CAST(t.place AS INTEGER) AS place, t.attachment_key, t.status, CAST(t.n_chars AS INTEGER) AS n_chars FROM latest l LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY CASE status WHEN 'ok' THEN 0 WHEN 'needs_ocr' THEN 1 WHEN 'missing' THEN 2 ELSE 3 END, n_chars DESC, attachment_key) AS place FROM texts) t ON t.item_key = l.item_key""",
    "unextracted_flags": "WITH "
    + _LATEST
    + """ SELECT l.item_key, coalesce(f.waiting, FALSE) AS waiting, coalesce(f.n, 0) AS n_attachments FROM latest l
      LEFT JOIN (SELECT item_key, bool_or(status <> 'ok') AS waiting, count(*) AS n FROM texts GROUP BY item_key) f ON f.item_key = l.item_key""",
    "corpus_records": "WITH " + _LATEST + "," + _CORPUS + " SELECT * FROM corpus",
    "corpus_coverage": "WITH "
    + _LATEST
    + ","
    + _CORPUS
    + """ SELECT item_type, count(*) AS n_items, count_if(has_abstract) AS n_abstract, count_if(has_tags) AS n_tags, count_if(has_text) AS n_text, avg(CAST(has_abstract AS DOUBLE)) AS abstract_rate
      FROM corpus GROUP BY item_type""",
    "field_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) AS n_rows, count_if({_known(c)}) AS n_known, count(DISTINCT CASE WHEN {_known(c)} THEN {c} END) AS n_distinct FROM library_items"
        for c in ("title", "creators_json", "year", "publication", "doi", "isbn", "url", "language", "abstract_note", "tags_json")
    ),
    "duplicate_items": "WITH "
    + _LATEST
    + rf""" SELECT reason, value, count(*) AS n_items, min(item_key) AS first_key FROM (
      SELECT item_key, 'doi' AS reason, CASE WHEN {_known("doi")} THEN lower(trim(doi)) END AS value FROM latest
      UNION ALL SELECT item_key, 'title', CASE WHEN {_known("title")} THEN regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_]+', '', 'g') END FROM latest)
      WHERE value <> '' GROUP BY reason, value HAVING count(*) > 1""",
    "missing_keys": f"""SELECT DISTINCT item_key FROM (SELECT item_key FROM item_events UNION ALL SELECT item_key FROM pdf_extraction UNION ALL SELECT zotero_item_key FROM reading_summary)
      WHERE {_known("item_key")} AND item_key NOT IN (SELECT item_key FROM library_items)""",
    "column_widths": " UNION ALL ".join(
        f"""SELECT '{c}' AS field, CAST(least(greatest(max(length(coalesce("{c}", '')) + length(regexp_replace(coalesce("{c}", ''), '[\\x00-\\x7F]', '', 'g'))) * 8 + 16, 60), 480) AS INTEGER) AS width_px FROM reading_summary"""
        for c in ("题目", "作者", "期刊/来源", "Tags")
    ),
    "request_results": "WITH "
    + _LATEST
    + f""" SELECT item_key, CAST(length(abstract_note) AS INTEGER) AS size, CASE WHEN coalesce(title, '') = '' THEN 'no_title' ELSE '' END AS error
      FROM latest WHERE coalesce(zotero_deleted, 0) = 0 AND {_known("abstract_note")}""",
}
