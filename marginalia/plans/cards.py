"""Queries over reading cards, affiliations and journal rankings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import scalars as S
from marginalia.functions.text import is_known, journal_key, known, trim_ws
from marginalia.operators import aggregate, merge
from marginalia.plans.items import _LATEST, _known, latest_items
from marginalia.sources.tables import read_table

#: Plain names for the columns of the summary table.
SUMMARY = {
    "人工参阅编号": "card_id", "zotero_item_key": "item_key", "题目": "title", "作者": "authors", "年份": "year", "期刊/来源": "venue",
    "期刊缩写": "venue_short", "Tags": "tags", "阅读状态": "read_status", "最后更新": "updated_at",
}
RANK_ORDER = ["sci", "eii", "cscd", "xr"]


def summary_rows(spark: SparkSession, base: str) -> DataFrame:
    """The newest row of every card."""
    rows = read_table(spark, base, "reading_summary").select(*(F.col(f"`{c}`").alias(n) for c, n in SUMMARY.items()))
    return merge.last_rows(rows, ["card_id"], ["updated_at"])


def card_rows(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "first_author_affiliations").distinct()
    return merge.last_rows(rows, ["card_id"], ["card_path"])


def summary_latest(spark: SparkSession, base: str) -> DataFrame:
    return summary_rows(spark, base).select("card_id", "item_key", "title", "year", "read_status")


def flow_counts(spark: SparkSession, base: str) -> DataFrame:
    """Counts by reading status, year and venue in one pass: grouping sets."""
    rows = summary_rows(spark, base).select(F.coalesce("read_status", F.lit("?")).alias("read_status"), F.coalesce("year", F.lit("?")).alias("year"))
    sets = rows.groupingSets([[F.col("read_status")], [F.col("year")], []], F.col("read_status"), F.col("year"))
    return sets.agg(F.count("*").alias("n_cards"), F.grouping_id().cast("int").alias("grouping"))


def affiliation_status(spark: SparkSession, base: str) -> DataFrame:
    rows = card_rows(spark, base)
    return rows.groupBy(F.coalesce("first_author_affiliation_status", F.lit("")).alias("status"), F.coalesce("first_author_affiliation_source", F.lit("")).alias("source")).agg(
        F.count("*").alias("n_cards"), F.count_if(is_known("first_author_affiliation")).alias("n_known")
    )


def rank_dictionary(spark: SparkSession, base: str) -> DataFrame:
    """The dictionary by key: rows without a key, and ok rows without ranks, are left out; the last row of a key counts."""
    rows = read_table(spark, base, "journal_rankings").where(is_known("normalized_name") & ((F.col("status") != "ok") | is_known("publication_tags")))
    return merge.last_rows(rows.select("normalized_name", "journal_name", "status", "publication_tags", "updated_at"), ["normalized_name"], ["updated_at"])


def rank_entries(spark: SparkSession, base: str) -> DataFrame:
    """Rank maps written again in a fixed order."""
    rows = rank_dictionary(spark, base).where("status = 'ok'").select("normalized_name", S.rank_map("publication_tags").alias("ranks"))
    return rows.select("normalized_name", S.rank_text(F.col("ranks"), RANK_ORDER).alias("ranks"), F.size("ranks").alias("n_ranks"))


def rank_bands(spark: SparkSession, base: str) -> DataFrame:
    """Journals by band of their best rank."""
    sci = S.rank_map("publication_tags")["sci"]
    band = F.when(sci == "Q1", "first").when(sci.isin("Q2", "Q3"), "middle").when(sci.isNotNull(), "last").otherwise("none")
    return rank_dictionary(spark, base).where("status = 'ok'").groupBy(band.alias("band")).agg(F.count("*").alias("n_journals"))


def rank_lookup(spark: SparkSession, base: str) -> DataFrame:
    """The rank of each card's venue: names are tried in order, the first that the dictionary knows decides, a known miss too."""
    cards = summary_rows(spark, base).select("card_id", F.array("venue", "venue_short").alias("names"))
    tried = cards.select("card_id", F.posexplode("names").alias("place", "name")).where(is_known("name"))
    keyed = tried.select("card_id", "place", "name", journal_key("name").alias("normalized_name"))
    found = keyed.join(rank_dictionary(spark, base).select("normalized_name", "status", "publication_tags"), "normalized_name")
    first = found.groupBy("card_id").agg(F.min(F.struct("place", "name", "status", "publication_tags")).alias("f"))
    ranks = F.when(F.col("f.status") == "ok", F.col("f.publication_tags")).otherwise("")
    return summary_rows(spark, base).select("card_id").join(first, "card_id", "left").select(
        "card_id", F.coalesce("f.name", F.lit("")).alias("name"), F.coalesce("f.status", F.lit("")).alias("status"), F.coalesce(ranks, F.lit("")).alias("ranks")
    )


def compact_author_cells(spark: SparkSession, base: str) -> DataFrame:
    rows = summary_rows(spark, base)
    return rows.select(
        "card_id", S.compact_authors("authors", F.lit("")).alias("authors"), F.size(S.split_list("tags", ";,|")).alias("n_tags"),
        F.array_join(S.split_list("tags", r";|,/", lower=True), "|").alias("tag_values"), S.markdown_escape("authors").alias("cell"),
    )


def filled_summary(spark: SparkSession, base: str) -> DataFrame:
    """Unknown venues and years of cards filled from their items."""
    items = latest_items(spark, base, ["publication", "journal_abbreviation", "year"]).select(
        "item_key", F.col("publication").alias("venue"), F.col("journal_abbreviation").alias("venue_short"), "year"
    )
    rows = summary_rows(spark, base).select("card_id", "item_key", "venue", "venue_short", "year")
    return merge.fill_unknown(rows, items, "item_key", ["venue", "venue_short", "year"])


def merged_summary(spark: SparkSession, base: str) -> DataFrame:
    """Summary rows merged with fresh card rows: known fresh cells win, cards that only one side has stay."""
    existing = summary_rows(spark, base).select("item_key", "card_id", F.lit("summary").alias("origin"))
    existing = existing.groupBy("item_key").agg(F.min("card_id").alias("card_id"), F.min("origin").alias("origin"))
    fresh = card_rows(spark, base).select(F.col("zotero_item_key").alias("item_key"), "card_id", F.when(F.col("first_author_affiliation_status") == "ok", "card").otherwise("?").alias("origin"))
    return merge.merge_known(existing, fresh, "item_key")


def numbered_cards(spark: SparkSession, base: str) -> DataFrame:
    """A running number over all cards, by path, without sorting them in one task."""
    rows = card_rows(spark, base).select("card_id", "card_path")
    return merge.numbered(rows, "number", [F.col("card_path"), F.col("card_id")]).select("card_id", "number", F.format_string("RC-%06d", F.col("number")).alias("label"))


def reminders(spark: SparkSession, base: str) -> DataFrame:
    """What is missing on cards, one row for each failed check."""
    rows = summary_rows(spark, base)
    checks = [
        ("no item", "high", ~is_known("item_key")),
        ("no authors", "high", ~is_known("authors")),
        ("no venue", "middle", ~is_known("venue") & ~is_known("venue_short")),
        ("no tags", "low", ~is_known("tags")),
        ("not read", "low", ~is_known("read_status")),
        ("odd year", "middle", is_known("year") & ~F.coalesce(F.col("year").rlike(r"^(19|20)\d\d$"), F.lit(False))),
    ]
    return aggregate.failed_checks(rows, "card_id", checks)


def field_mismatches(spark: SparkSession, base: str) -> DataFrame:
    """Cells of cards that differ from those of their items, both known."""
    items = latest_items(spark, base, ["title", "year", "publication"]).select("item_key", F.col("title").alias("i_title"), F.col("year").alias("i_year"), F.col("publication").alias("i_venue"))
    joined = summary_rows(spark, base).join(items, "item_key")
    pairs = [("title", F.col("title"), F.col("i_title")), ("year", F.col("year"), F.col("i_year")), ("venue", F.col("venue"), F.col("i_venue"))]
    return aggregate.mismatches(joined, "card_id", pairs, is_known)


def card_paths(spark: SparkSession, base: str) -> DataFrame:
    rows = card_rows(spark, base)
    path = F.concat(F.lit("D:\\work\\"), F.replace(F.col("card_path"), F.lit("/"), F.lit("\\")))
    return rows.select("card_id", S.portable_path(path, "corpus").alias("path"), S.attachment_key(F.concat(F.lit("pdf "), "zotero_item_key")).alias("key"), S.key_upper("zotero_item_key").alias("item_key"))


def authoritative_affiliations(spark: SparkSession, base: str) -> DataFrame:
    """Cards whose affiliation may be overwritten, and those that may not."""
    rows = card_rows(spark, base)
    fixed = (F.coalesce("first_author_affiliation_status", F.lit("")) == "ok") & is_known("first_author_affiliation")
    return rows.select("card_id", fixed.alias("fixed"), S.first_known("first_author_affiliation", "first_author_affiliation_raw").alias("affiliation"))


QUERIES = {
    f.__name__: f
    for f in (
        summary_latest, flow_counts, affiliation_status, rank_dictionary, rank_entries, rank_bands, rank_lookup, compact_author_cells, filled_summary, merged_summary,
        numbered_cards, reminders, field_mismatches, card_paths, authoritative_affiliations,
    )
}

_SUMMARY = """
    summary AS (SELECT * FROM (SELECT "人工参阅编号" AS card_id, zotero_item_key AS item_key, "题目" AS title, "作者" AS authors, "年份" AS year, "期刊/来源" AS venue, "期刊缩写" AS venue_short,
      "Tags" AS tags, "阅读状态" AS read_status, row_number() OVER (PARTITION BY "人工参阅编号" ORDER BY "最后更新" DESC NULLS LAST) AS p FROM reading_summary) WHERE p = 1),
    cards AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY card_path DESC NULLS LAST) AS p FROM (SELECT DISTINCT * FROM first_author_affiliations)) WHERE p = 1),
    dictionary AS (SELECT * FROM (SELECT normalized_name, journal_name, status, publication_tags, updated_at, row_number() OVER (PARTITION BY normalized_name ORDER BY updated_at DESC NULLS LAST) AS p
      FROM journal_rankings WHERE %s AND (status <> 'ok' OR %s)) WHERE p = 1)
""" % (_known("normalized_name"), _known("publication_tags"))
_RANKS = r"""
    ranks AS (SELECT normalized_name, k, v FROM (SELECT normalized_name, lower(trim(string_split(part, ':')[1])) AS k, trim(regexp_replace(part, '^[^:]*:', '')) AS v
      FROM (SELECT normalized_name, unnest(string_split(publication_tags, ';')) AS part FROM dictionary WHERE status = 'ok') WHERE contains(part, ':')) WHERE k <> '' AND v <> '')
"""
_SPLIT = "list_filter(list_transform(regexp_split_to_array({0}, '[{1}]+'), lambda x: trim(x, e' \\t\\n\\r')), lambda x: x <> '')"

ORACLES = {
    "summary_latest": "WITH " + _SUMMARY + " SELECT card_id, item_key, title, year, read_status FROM summary",
    "flow_counts": "WITH "
    + _SUMMARY
    + """ SELECT read_status, year, count(*) AS n_cards, CAST(grouping(read_status, year) AS INTEGER) AS grouping FROM (
      SELECT coalesce(read_status, '?') AS read_status, coalesce(year, '?') AS year FROM summary) GROUP BY GROUPING SETS ((read_status), (year), ())""",
    "affiliation_status": "WITH "
    + _SUMMARY
    + f""" SELECT coalesce(first_author_affiliation_status, '') AS status, coalesce(first_author_affiliation_source, '') AS source, count(*) AS n_cards,
      count_if({_known("first_author_affiliation")}) AS n_known FROM cards GROUP BY ALL""",
    "rank_dictionary": "WITH " + _SUMMARY + " SELECT normalized_name, journal_name, status, publication_tags, updated_at FROM dictionary",
    "rank_entries": "WITH "
    + _SUMMARY
    + ","
    + _RANKS
    + """ SELECT normalized_name, string_agg(k || ': ' || v, '; ' ORDER BY list_position(['sci', 'eii', 'cscd', 'xr'], k)) AS ranks, CAST(count(*) AS INTEGER) AS n_ranks FROM ranks GROUP BY normalized_name""",
    "rank_bands": "WITH "
    + _SUMMARY
    + ","
    + _RANKS
    + """ SELECT CASE WHEN v = 'Q1' THEN 'first' WHEN v IN ('Q2', 'Q3') THEN 'middle' WHEN v IS NOT NULL THEN 'last' ELSE 'none' END AS band, count(*) AS n_journals
      FROM (SELECT d.normalized_name, r.v FROM dictionary d LEFT JOIN ranks r ON r.normalized_name = d.normalized_name AND r.k = 'sci' WHERE d.status = 'ok') GROUP BY band""",
    "rank_lookup": "WITH "
    + _SUMMARY
    + rf""", tried AS (SELECT card_id, 0 AS place, venue AS name FROM summary WHERE {_known("venue")} UNION ALL SELECT card_id, 1, venue_short FROM summary WHERE {_known("venue_short")}),
      found AS (SELECT t.*, d.status, d.publication_tags, row_number() OVER (PARTITION BY card_id ORDER BY place) AS p FROM tried t JOIN dictionary d ON d.normalized_name = regexp_replace(lower(t.name), '[^\p{{L}}\p{{N}}_]+', '', 'g'))
      SELECT s.card_id, coalesce(f.name, '') AS name, coalesce(f.status, '') AS status, coalesce(CASE WHEN f.status = 'ok' THEN f.publication_tags ELSE '' END, '') AS ranks
      FROM summary s LEFT JOIN found f ON f.card_id = s.card_id AND f.p = 1""",
    "compact_author_cells": "WITH "
    + _SUMMARY
    + f""", cells AS (SELECT card_id, authors AS a, CASE WHEN {_known("authors")} THEN {_SPLIT.format("authors", ";,|")} ELSE [] END AS people,
        CASE WHEN {_known("tags")} THEN {_SPLIT.format("tags", ";,|")} ELSE [] END AS tags, CASE WHEN {_known("tags")} THEN {_SPLIT.format("lower(tags)", ";|,/")} ELSE [] END AS low FROM summary)
      SELECT card_id, CASE WHEN len(people) = 0 THEN trim(coalesce(a, ''), e' \\t\\n\\r') ELSE array_to_string(people[1:2], '; ') END AS authors, CAST(len(tags) AS INTEGER) AS n_tags,
        array_to_string(low, '|') AS tag_values, regexp_replace(replace(coalesce(a, ''), '|', '\\|'), '\\r?\\n', ' ', 'g') AS cell FROM cells""",
    "filled_summary": "WITH "
    + _LATEST
    + ","
    + _SUMMARY
    + " SELECT s.card_id, s.item_key, "
    + ", ".join(
        f"CASE WHEN NOT {_known('s.' + a)} AND {_known('l.' + b)} THEN l.{b} ELSE s.{a} END AS {a}" for a, b in (("venue", "publication"), ("venue_short", "journal_abbreviation"), ("year", "year"))
    )
    + " FROM summary s LEFT JOIN latest l ON l.item_key = s.item_key",
    "merged_summary": "WITH "
    + _SUMMARY
    + f""", existing AS (SELECT item_key, min(card_id) AS card_id, 'summary' AS origin FROM summary GROUP BY item_key),
      keyed AS (SELECT lower(item_key) AS k, * FROM existing WHERE {_known("item_key")}),
      fresh AS (SELECT zotero_item_key AS item_key, card_id, CASE WHEN first_author_affiliation_status = 'ok' THEN 'card' ELSE '?' END AS origin FROM cards)
      SELECT f.item_key, f.card_id, CASE WHEN f.origin <> '?' THEN f.origin ELSE coalesce(e.origin, '') END AS origin FROM fresh f LEFT JOIN keyed e ON e.k = lower(f.item_key) AND {_known("f.item_key")}
      UNION ALL SELECT item_key, card_id, origin FROM keyed WHERE k NOT IN (SELECT lower(item_key) FROM fresh WHERE {_known("item_key")})""",
    "numbered_cards": "WITH " + _SUMMARY + " SELECT card_id, number, printf('RC-%06d', number) AS label FROM (SELECT card_id, row_number() OVER (ORDER BY card_path, card_id) AS number FROM cards)",
    "reminders": "WITH "
    + _SUMMARY
    + " UNION ALL ".join(
        f" SELECT card_id, '{issue}' AS issue, '{severity}' AS severity FROM summary WHERE {test}"
        for issue, severity, test in (
            ("no item", "high", f"NOT {_known('item_key')}"),
            ("no authors", "high", f"NOT {_known('authors')}"),
            ("no venue", "middle", f"NOT {_known('venue')} AND NOT {_known('venue_short')}"),
            ("no tags", "low", f"NOT {_known('tags')}"),
            ("not read", "low", f"NOT {_known('read_status')}"),
            ("odd year", "middle", f"{_known('year')} AND NOT coalesce(regexp_full_match(year, '(19|20)[0-9][0-9]'), FALSE)"),
        )
    ),
    "field_mismatches": "WITH "
    + _LATEST
    + ","
    + _SUMMARY
    + " UNION ALL ".join(
        f" SELECT s.card_id, '{f}' AS field, s.{f} AS left_value, l.{b} AS right_value FROM summary s JOIN latest l ON l.item_key = s.item_key WHERE {_known('s.' + f)} AND {_known('l.' + b)} AND lower(trim(s.{f})) <> lower(trim(l.{b}))"
        for f, b in (("title", "title"), ("year", "year"), ("venue", "publication"))
    ),
    "card_paths": "WITH " + _SUMMARY + " SELECT card_id, card_path AS path, coalesce(zotero_item_key, '') AS key, upper(trim(coalesce(zotero_item_key, ''))) AS item_key FROM cards",
    "authoritative_affiliations": "WITH "
    + _SUMMARY
    + f""" SELECT card_id, coalesce(first_author_affiliation_status, '') = 'ok' AND {_known("first_author_affiliation")} AS fixed,
      coalesce(CASE WHEN {_known("first_author_affiliation")} THEN trim(first_author_affiliation, e' \\t\\n\\r') END, CASE WHEN {_known("first_author_affiliation_raw")} THEN trim(first_author_affiliation_raw, e' \\t\\n\\r') END, '') AS affiliation FROM cards""",
}
