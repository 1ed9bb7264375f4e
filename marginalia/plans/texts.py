"""Queries over extracted texts and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import paragraphs, scalars as S
from marginalia.sources.tables import read_table


def extracted(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "pdf_extraction").where("status = 'ok'").select("attachment_key", "text").distinct()


def text_normalize(spark: SparkSession, base: str) -> DataFrame:
    """White space of documents compacted; sizes before and after."""
    rows = read_table(spark, base, "documents").select("doc_id", "text")
    return rows.select("doc_id", F.length("text").alias("n_before"), F.length(S.compact_whitespace("text")).alias("n_after"), F.md5(S.compact_whitespace("text")).alias("digest"))


def text_slices(spark: SparkSession, base: str) -> DataFrame:
    """Texts cut to 12,000 characters for a packet: the cut is the packet's feature."""
    return extracted(spark, base).select("attachment_key", F.md5(S.compact_text("text", 12000)).alias("digest"), F.length(S.compact_text("text", 12000)).alias("n_chars"))


def first_page_texts(spark: SparkSession, base: str) -> DataFrame:
    """The first page of each text, up to 4,000 characters as in a record of the corpus."""
    page = S.first_page("text", 4000)
    return extracted(spark, base).select("attachment_key", page.alias("page"))


def first_pages(spark: SparkSession, base: str) -> DataFrame:
    """Pages 1 and 2 with their page lines."""
    return extracted(spark, base).select("attachment_key", F.md5(S.first_pages("text", 2)).alias("digest"), F.length(S.first_pages("text", 2)).alias("n_chars"))


def page_counts(spark: SparkSession, base: str) -> DataFrame:
    """Pages by their page lines against the pages that are stated."""
    rows = read_table(spark, base, "pdf_extraction").where("status = 'ok'").select("attachment_key", "method", "pages_total", "pages_with_text", "text").distinct()
    marked = F.size(F.regexp_extract_all("text", F.lit(r"(?m)^===== Page (\d+)"), F.lit(1)))
    return rows.select("attachment_key", "method", marked.alias("n_marked"), (marked == F.col("pages_total")).alias("complete"), (F.col("pages_with_text") < F.col("pages_total")).alias("blank_pages"))


def extraction_status(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "pdf_extraction").distinct()
    return rows.groupBy("status", "method").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"), F.count_if(F.length(F.trim("text")) < 100).alias("n_short"))


def document_sections(spark: SparkSession, base: str) -> DataFrame:
    """Markdown documents by heading."""
    rows = read_table(spark, base, "documents").where(F.col("text").rlike(r"(?m)^#{1,6}\s")).select("doc_id", "text")
    return rows.select("doc_id", F.explode(paragraphs.section_list("text")).alias("s")).select("doc_id", "s.heading", "s.body")


def reflowed_texts(spark: SparkSession, base: str) -> DataFrame:
    """Texts as paragraphs: page lines and list items stand alone."""
    return extracted(spark, base).select("attachment_key", paragraphs.reflow_text("text").alias("text"))


def document_sources(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "documents")
    return rows.groupBy("source", "section", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.max(F.length("text")).alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (text_normalize, text_slices, first_page_texts, first_pages, page_counts, extraction_status, document_sections, reflowed_texts, document_sources)
}

_OK = "ok AS (SELECT DISTINCT attachment_key, replace(replace(text, e'\\r\\n', e'\\n'), e'\\r', e'\\n') AS text FROM pdf_extraction WHERE status = 'ok')"
_COMPACT = "trim(regexp_replace(regexp_replace({0}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', e'\\n\\n', 'g'), e' \\t\\n\\r')"

# lines as rows, and windows over them, where the queries have patterns over whole texts
_LINED = "lined AS (SELECT {0} AS k, unnest(string_split({1}, e'\\n')) AS line, generate_subscripts(string_split({1}, e'\\n'), 1) AS no FROM {2})"

ORACLES = {
    "document_sections": "WITH "
    + _LINED.format("doc_id", "text", "documents")
    + r""", headed AS (SELECT *, regexp_extract(line, '^#{1,6}[ \t]+(\S.*?)[ \t]*$', 1) AS title, count(CASE WHEN regexp_matches(line, '^#{1,6}[ \t]+\S') THEN 1 END) OVER (PARTITION BY k ORDER BY no) AS part FROM lined),
      named AS (SELECT *, trim(regexp_replace(regexp_replace(first_value(title) OVER (PARTITION BY k, part ORDER BY no), '^[^\p{L}\p{N}]+', ''), '^[0-9]+(?:\.[0-9]+)*\.?\s+', '')) AS heading,
          no = first_value(no) OVER (PARTITION BY k, part ORDER BY no) AS first FROM headed WHERE part > 0)
      SELECT k AS doc_id, heading, coalesce(string_agg(trim(line, e' \t\r\n'), ' ' ORDER BY no) FILTER (NOT first AND trim(line, e' \t\r\n') NOT IN ('', '?')), '') AS body FROM named WHERE heading <> '' GROUP BY k, heading""",
    "reflowed_texts": "WITH ok AS (SELECT DISTINCT attachment_key, text FROM pdf_extraction WHERE status = 'ok'), "
    + _LINED.format("attachment_key || md5(text)", "text", "ok")
    + r""", clean AS (SELECT k, no, regexp_replace(trim(line, e' \t\r\f'), '\s+', ' ', 'g') AS line FROM lined),
      sorted AS (SELECT *, CASE WHEN line = '' THEN 0 WHEN regexp_full_match(line, '(?i)=+ ?page [0-9]+\b[^=]*=+|[-*+•] .*|\(?[0-9]+[.)] .*|[a-z][.)] .*') THEN 1 ELSE 2 END AS kind FROM clean),
      beside AS (SELECT *, lag(kind) OVER w AS before, lead(line) OVER w AS next, lead(kind) OVER w AS next_kind FROM sorted WINDOW w AS (PARTITION BY k ORDER BY no)),
      placed AS (SELECT *, count(CASE WHEN kind = 1 OR (kind = 2 AND before IS DISTINCT FROM 2) THEN 1 END) OVER (PARTITION BY k ORDER BY no) AS block FROM beside WHERE kind > 0),
      joined AS (SELECT k, block, string_agg(CASE
          WHEN kind = 1 OR next_kind IS DISTINCT FROM 2 THEN line
          WHEN line LIKE '%-' AND regexp_matches(next, '^[a-z]') THEN line[:-2]
          WHEN regexp_matches(line, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]$') AND regexp_matches(next, '^[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]') THEN line
          WHEN contains(',.;:!?)]}%，。；：！？、）】》', next[1]) OR contains('([{《【', line[-1]) THEN line
          ELSE line || ' ' END, '' ORDER BY no) AS block_text FROM placed GROUP BY k, block)
      SELECT attachment_key, coalesce(string_agg(block_text, e'\n\n' ORDER BY block) || e'\n', '') AS text FROM ok LEFT JOIN joined ON k = attachment_key || md5(text) GROUP BY attachment_key, ok.text""",
    "first_pages": r"""WITH ok AS (SELECT DISTINCT attachment_key, text FROM pdf_extraction WHERE status = 'ok'), """
    + _LINED.format("attachment_key || md5(text)", "text", "ok")
    + r""", paged AS (SELECT *, count(CASE WHEN regexp_matches(line, '^===== Page [0-9]+ =====[ \t]*$') THEN 1 END) OVER (PARTITION BY k ORDER BY no) AS part FROM lined),
      parts AS (SELECT k, part, trim(string_agg(line, e'\n' ORDER BY no), e' \t\n\r') AS page FROM paged WHERE part > 0 GROUP BY k, part),
      marked AS (SELECT k, string_agg(page, e'\n\n' ORDER BY part) FILTER (CAST(regexp_extract(page, '[0-9]+') AS INTEGER) <= 2) AS kept FROM parts GROUP BY k)
      SELECT attachment_key, md5(c) AS digest, CAST(length(c) AS INTEGER) AS n_chars FROM (SELECT attachment_key, CASE WHEN m.k IS NULL THEN text ELSE coalesce(kept, '') END AS c FROM ok LEFT JOIN marked m ON m.k = attachment_key || md5(text))""",
    "text_normalize": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n_before, CAST(length(c) AS INTEGER) AS n_after, md5(c) AS digest FROM (SELECT doc_id, text, "
    + _COMPACT.format("replace(replace(text, e'\\r\\n', e'\\n'), e'\\r', e'\\n')")
    + " AS c FROM documents)",
    "text_slices": f"WITH {_OK} SELECT attachment_key, md5(c) AS digest, CAST(length(c) AS INTEGER) AS n_chars FROM (SELECT attachment_key, rtrim(substr(regexp_replace(text, '\\n{{4,}}', e'\\n\\n\\n', 'g'), 1, 12000), e' \\t\\n\\r') AS c FROM ok)",
    "first_page_texts": f"WITH {_OK}, pages AS (SELECT attachment_key, text, regexp_split_to_array(text, '(?m)^===== Page [0-9]+ =====[ \\t]*$') AS parts FROM ok) SELECT attachment_key, rtrim(substr("
    + _COMPACT.format("CASE WHEN len(parts) > 1 THEN parts[2] ELSE text END")
    + ", 1, 4000), e' \\t\\n\\r') AS page FROM pages",
    "page_counts": """SELECT attachment_key, method, CAST(n AS INTEGER) AS n_marked, n = pages_total AS complete, pages_with_text < pages_total AS blank_pages FROM (
      SELECT DISTINCT attachment_key, method, pages_total, pages_with_text, len(regexp_extract_all(text, '(?m)^===== Page ([0-9]+)')) AS n, text FROM pdf_extraction WHERE status = 'ok')""",
    "extraction_status": "SELECT status, method, count(*) AS n, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars, count_if(length(trim(text)) < 100) AS n_short FROM (SELECT DISTINCT * FROM pdf_extraction) GROUP BY ALL",
    "document_sources": "SELECT source, section, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(max(length(text)) AS INTEGER) AS longest FROM documents GROUP BY ALL",
}
