"""Sinks and sources by writing whole tables and reading them back, and streams run to their end; with the SQL of what must come out.

What is written lies in the shared folder of the session and is deleted when its driver ends.
"""

from __future__ import annotations

import functools
import uuid

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import scalars as S
from marginalia.functions.text import is_known
from marginalia.operators import merge, rules
from marginalia.plans.cards import _SUMMARY, card_rows, summary_rows
from marginalia.plans.items import _LATEST, _known, latest_items
from marginalia.plans.tags import _TAGS, TOPICS, _TOPIC
from marginalia.session import own_folder
from marginalia.sources import files, sinks
from marginalia.sources.paged import PagedSource
from marginalia.sources.tables import read_table
from marginalia.streaming import incremental


def _place(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def csv_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Items through CSV files: the listed fields, a missing one empty."""
    path, fields = _place(spark, "csv"), ["item_key", "title", "publication", "tags_json", "none"]
    sinks.write_csv(latest_items(spark, base, fields[1:4]), path, fields)
    return files.read_csv(spark, path, fields, ["item_key"]).select(*(S.text_of(f).alias(f) for f in fields))


def jsonl_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Events through JSON lines, read strictly."""
    path = _place(spark, "jsonl")
    sinks.write_jsonl(read_table(spark, base, "item_events").select("event_id", "item_key", "event_type", "details_json").distinct(), path)
    return files.read_jsonl(spark, path, "event_id long, item_key string, event_type string, details_json string")


def json_document(spark: SparkSession, base: str) -> DataFrame:
    """The listed journals through one JSON document: a report of bounded size."""
    path = _place(spark, "json")
    listed = read_table(spark, base, "journal_rankings").where("status = 'ok'").select("normalized_name", "publication_tags").distinct()
    sinks.write_json(listed, path, {"kind": "journals"})
    return files.read_json_items(spark, path, "struct<normalized_name:string, publication_tags:string>")


def event_log(spark: SparkSession, base: str) -> DataFrame:
    """Keys appended to a log twice, missing columns by their default: rows by state."""
    path = _place(spark, "log")
    rows = latest_items(spark, base, []).select("item_key")
    sinks.append_events(rows, path, {"status": "new"})
    sinks.append_events(rows.withColumn("status", F.lit("seen")), path, {"status": "new"})
    return spark.read.schema("item_key string, status string").json(path).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("item_key").alias("n_items"))


def text_cache(spark: SparkSession, base: str) -> DataFrame:
    """Texts added to a cache twice: counts by outcome and turn."""
    path = _place(spark, "cache")
    rows = merge.last_rows(read_table(spark, base, "pdf_extraction").select("item_key", "attachment_key", "extracted_at", "text"), ["attachment_key"], ["extracted_at"])
    first = sinks.write_texts(rows, path).withColumn("turn", F.lit(1))
    return first.unionByName(sinks.write_texts(rows, path).withColumn("turn", F.lit(2))).select("turn", "outcome", "n")


def topic_folders(spark: SparkSession, base: str) -> DataFrame:
    """Items written by topic, then a smaller state over it: partitions that are gone are gone."""
    path = _place(spark, "topics")
    items = latest_items(spark, base, ["tags_json"])
    topics = rules.topics_of(items, "item_key", S.known_strings("tags_json"), TOPICS)
    sinks.write_by_topic(items.select("item_key"), topics, "item_key", path)
    sinks.write_by_topic(items.select("item_key"), topics.where("topic <> 'T1'"), "item_key", path)
    return spark.read.parquet(path).groupBy("topic").agg(F.count("*").alias("n_items"))


def card_files(spark: SparkSession, base: str) -> DataFrame:
    """Cards as Markdown texts: metadata written in front and at the tail, the tail's written anew, both read; the front wins."""
    own = card_rows(spark, base).select("card_id", F.create_map(F.lit("card"), F.col("card_id"), F.lit("status"), S.text_of("first_author_affiliation_status")).alias("front"))
    state = summary_rows(spark, base).select("card_id", F.create_map(F.lit("status"), F.lit("lost"), F.lit("year"), S.text_of("year")).alias("tail"))
    first = files.with_metadata(F.concat(F.lit("# "), F.col("card_id"), F.lit("\n\nbody\n")), F.create_map(F.lit("year"), F.lit("0")))
    text = files.with_metadata(files.with_metadata(first, F.col("tail")), F.col("front"), "front")
    found = own.join(state, "card_id").select(files.card_metadata(text).alias("m"), F.length(text).alias("size"))
    return found.select(*(F.coalesce(F.col("m")[k], F.lit("")).alias(k) for k in ("card", "status", "year")), "size")


def markdown_rows(spark: SparkSession, base: str) -> DataFrame:
    """Summary rows as lines of Markdown tables, one table for each year, read again by their linked keys."""
    rows = summary_rows(spark, base).where(is_known("item_key"))
    line = F.concat(F.lit("| ["), "item_key", F.lit("](x://items/"), "item_key", F.lit(") | "), F.col("card_id"), F.lit(" | "), S.markdown_escape("venue_short"), F.lit(" |"))
    tables = rows.groupBy("year").agg(F.array_join(F.collect_list(line), "\n").alias("table"))
    read = tables.select(F.explode(files.markdown_table(F.concat(F.lit("| Key | Card | Venue |\n| --- | --- | --- |\n"), "table"), ["card_id", "venue"])).alias("r"))
    return read.select("r.key", "r.card_id", F.replace("r.venue", F.lit("\\|"), F.lit("|")).alias("venue"))


def packets(spark: SparkSession, base: str) -> DataFrame:
    """One Markdown section for each item with an abstract: sizes and digests."""
    rows = latest_items(spark, base, ["title", "year", "abstract_note"]).where(is_known("abstract_note"))
    text = sinks.packet(F.col("title"), {"key": F.col("item_key"), "year": F.col("year")}, F.col("abstract_note"))
    return rows.select("item_key", F.length(text).alias("size"), F.md5(text).alias("digest"))


def materials(spark: SparkSession, base: str) -> DataFrame:
    """Extracted texts as files of a folder, read as material: name, state and size."""
    path = _place(spark, "materials")
    rows = merge.last_rows(read_table(spark, base, "pdf_extraction").where("status = 'ok'").select("attachment_key", "extracted_at", "text"), ["attachment_key"], ["extracted_at"])
    rows.select(F.regexp_replace("text", r"\r\n?", "\n").alias("value"), "attachment_key").repartition(8, "attachment_key").write.partitionBy("attachment_key").text(path)
    found = files.read_materials(spark, path)
    return found.select(F.regexp_extract("path", r"attachment_key=([^/]+)/", 1).alias("attachment_key"), "kind", "status", F.length("text").alias("size"))


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@functools.lru_cache(1 << 16)
def _group_sizes(table: str, path: str, size: int, changed: int) -> list[int]:
    """Rows of each row group of a file of a Parquet table; a worker reads them once as long as the file stays as it is."""
    metadata = pq.ParquetFile(path, filesystem=_system(table)[0]).metadata
    return [metadata.row_group(k).num_rows for k in range(metadata.num_row_groups)]


def _files(system: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    """The files of a Parquet table, which is one file or a folder of them; hidden ones don't belong to it."""
    found = system.get_file_info(path)
    if found.type == pafs.FileType.Directory:
        inside = (x for x in system.get_file_info(pafs.FileSelector(path, recursive=True)) if x.type == pafs.FileType.File)
        return sorted((x for x in inside if not any(part[:1] in "_." for part in x.path[len(path) :].strip("/").split("/"))), key=lambda x: x.path)
    return [found]


def fetch_rows(start: int, limit: int, path: str = "") -> list[dict]:
    """Rows start to start + limit of a Parquet table as a remote collection would give them; only row groups that hold any are read."""
    system, place = _system(path)
    at, rows = 0, []
    for info in _files(system, place):
        file = None
        for group, n in enumerate(_group_sizes(path, info.path, info.size, info.mtime_ns)):
            if at < start + limit and at + n > start:
                file = file or pq.ParquetFile(info.path, filesystem=system)
                first = max(0, start - at)
                rows += file.read_row_group(group, columns=["item_key", "version", "title"]).slice(first, start + limit - at - first).to_pylist()
            at += n
        if at >= start + limit:
            break
    return [{"key": r["item_key"], "version": r["version"], "data": {"title": r["title"]}} for r in rows]


def paged_items(spark: SparkSession, base: str) -> DataFrame:
    """The items table as a paged remote collection, its pages fetched in parallel."""
    spark.dataSource.register(PagedSource)
    total = read_table(spark, base, "library_items").count()
    # a page is held by its task as a whole, so pages of large tables are more, not larger
    options = {"fetcher": "marginalia.plans.round_trips:fetch_rows", "page_size": min(max(100, total // 64), 50_000), "total": total, "path": f"{base}/library_items.parquet"}
    record = spark.read.format("paged").options(**options).load().select(F.from_json("record", "key string, version int, data struct<title: string>").alias("r"))
    return record.select("r.key", "r.version", F.md5(S.text_of(F.col("r.data.title"))).alias("title")).groupBy("key", "version", "title").agg(F.count("*").alias("n"))


_EVENTS = "event_id long, item_key string, event_type string, details_json string, event_at timestamp, detected_at timestamp"


def _arriving(spark: SparkSession, base: str) -> DataFrame:
    """The events as files that arrive in a folder, and a stream over them."""
    path = _place(spark, "arriving")
    read_table(spark, base, "item_events").select(*(c.split()[0] for c in _EVENTS.split(", "))).write.parquet(path)
    return incremental.read_events(spark, path, _EVENTS, 2)


def streamed_state(spark: SparkSession, base: str) -> DataFrame:
    """The last event of every item, folded batch by batch into a versioned table."""
    table, point = _place(spark, "state"), _place(spark, "point")
    incremental.upsert_stream(_arriving(spark, base), table, point, ["item_key"], ["event_at", "event_id"]).awaitTermination()
    return incremental.read_versioned(spark, table).select("item_key", "event_id", "event_type")


def streamed_once(spark: SparkSession, base: str) -> DataFrame:
    """Events handed on once each, replays dropped: counts by type."""
    path, point = _place(spark, "once"), _place(spark, "point")
    sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    incremental.emit_once(_arriving(spark, base), "event_id", "event_at", "3650 days", sink, point).awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n_events"), F.count_distinct("event_id").alias("n_ids"))


def streamed_windows(spark: SparkSession, base: str) -> DataFrame:
    """Events per day in event time, counted by a stream with its late ones."""
    path, point = _place(spark, "windows"), _place(spark, "point")
    counts = incremental.windowed_counts(_arriving(spark, base).dropDuplicates(["event_id"]), "event_at", "1 day", [])
    keep = lambda batch, number: batch.select(F.col("window.start").alias("day"), "n_events").write.mode("overwrite").parquet(f"{path}/batch={number}")
    query = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", point).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(path)
    return rows.join(rows.agg(F.max("batch").alias("batch")), "batch").select("day", "n_events")


QUERIES = {
    f.__name__: f
    for f in (
        csv_round_trip, jsonl_round_trip, json_document, event_log, text_cache, topic_folders, card_files, markdown_rows, packets, materials, paged_items, streamed_state, streamed_once, streamed_windows,
    )
}

_NEWEST_TEXTS = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attachment_key ORDER BY extracted_at DESC NULLS LAST, item_key DESC, text DESC NULLS LAST) AS p FROM pdf_extraction{0}) WHERE p = 1)"

ORACLES = {
    "csv_round_trip": "WITH " + _LATEST.rstrip().rstrip(",") + " SELECT item_key, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in ("title", "publication", "tags_json")) + ", '' AS none FROM latest",
    "jsonl_round_trip": "SELECT DISTINCT event_id, item_key, event_type, details_json FROM item_events",
    "json_document": "SELECT DISTINCT normalized_name, publication_tags FROM journal_rankings WHERE status = 'ok'",
    "event_log": "SELECT unnest(['new', 'seen']) AS status, n, n AS n_items FROM (SELECT count(DISTINCT item_key) AS n FROM library_items)",
    "text_cache": "WITH "
    + _NEWEST_TEXTS.format("")
    + """, judged AS (SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'skipped' ELSE 'kept' END AS o FROM newest)
      SELECT turn, CASE WHEN o = 'skipped' THEN o WHEN turn = 1 THEN 'exported' ELSE 'linked_existing' END AS outcome, count(*) AS n FROM judged, (SELECT unnest([1, 2]) AS turn) GROUP BY ALL""",
    "topic_folders": _TAGS
    + f", found AS (SELECT item_key, list_filter({_TOPIC}, lambda x: x IS NOT NULL) AS t FROM listed), spread AS (SELECT unnest(CASE WHEN len(t) > 0 THEN t ELSE ['UNCLASSIFIED'] END) AS topic FROM found) SELECT topic, count(*) AS n_items FROM spread WHERE topic <> 'T1' GROUP BY topic",
    "card_files": "WITH "
    + _SUMMARY
    + """ SELECT c.card_id AS card, coalesce(first_author_affiliation_status, '') AS status, coalesce(year, '') AS year,
      CAST(length('---' || e'\\n' || 'card: ' || c.card_id || e'\\n' || 'status: ' || coalesce(first_author_affiliation_status, '') || e'\\n' || '---' || e'\\n' || '# ' || c.card_id || e'\\n\\n' || 'body' || e'\\n\\n' || '## Machine metadata'
        || e'\\n\\n' || '```yaml' || e'\\n' || 'status: lost' || e'\\n' || 'year: ' || coalesce(year, '') || e'\\n' || '```' || e'\\n') AS INTEGER) AS size FROM cards c JOIN summary s ON s.card_id = c.card_id""",
    "markdown_rows": "WITH " + _SUMMARY + f" SELECT item_key AS key, card_id, trim(coalesce(venue_short, '')) AS venue FROM summary WHERE {_known('item_key')}",
    "packets": "WITH "
    + _LATEST.rstrip().rstrip(",")
    + f""", made AS (SELECT item_key, '## ' || coalesce(title, '') || e'\\n\\n- key: ' || item_key || e'\\n- year: ' || coalesce(year, '') || e'\\n\\n' || abstract_note || e'\\n' AS t FROM latest WHERE {_known("abstract_note")})
      SELECT item_key, CAST(length(t) AS INTEGER) AS size, md5(t) AS digest FROM made""",
    "materials": "WITH "
    + _NEWEST_TEXTS.format(" WHERE status = 'ok'")
    + " SELECT attachment_key, 'txt' AS kind, 'ok' AS status, CAST(length(regexp_replace(coalesce(text, ''), '\\r\\n?', e'\\n', 'g')) + 1 AS INTEGER) AS size FROM newest",
    "paged_items": "SELECT item_key AS key, version, md5(coalesce(title, '')) AS title, count(*) AS n FROM library_items GROUP BY ALL",
    "streamed_state": "SELECT item_key, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY event_at DESC NULLS LAST, event_id DESC) AS p FROM item_events) WHERE p = 1",
    "streamed_once": "SELECT event_type, count(*) AS n_events, count(*) AS n_ids FROM (SELECT DISTINCT event_id, event_type FROM item_events) GROUP BY event_type",
    "streamed_windows": "SELECT date_trunc('day', event_at) AS day, count(*) AS n_events FROM (SELECT DISTINCT event_id, event_at FROM item_events) GROUP BY ALL",
}
