"""Queries over change events and table maintenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.operators import aggregate, merge
from marginalia.plans.items import _LATEST, latest_items
from marginalia.sources.tables import read_table
from marginalia.streaming import incremental

#: The old state of the library is what was synced before this moment.
CUT = "2024-01-01 00:00:00"


def events(spark: SparkSession, base: str) -> DataFrame:
    """Events once each: replays of an event_id are merged."""
    rows = read_table(spark, base, "item_events")
    return merge.last_rows(rows, ["event_id"], ["detected_at"])


def event_replays(spark: SparkSession, base: str) -> DataFrame:
    """How many events came more than once, by type."""
    counts = read_table(spark, base, "item_events").groupBy("event_id").agg(F.count("*").alias("times"), F.min("event_type").alias("event_type"))
    return counts.groupBy("event_type").agg(F.count("*").alias("n_events"), F.count_if(F.col("times") > 1).alias("n_replayed"), F.sum("times").alias("n_rows"))


def state_fold(spark: SparkSession, base: str) -> DataFrame:
    """The last event of every item replaces its whole state."""
    last = merge.last_rows(events(spark, base).select("item_key", "event_at", "event_id", "event_type", "details_json"), ["item_key"], ["event_at", "event_id"])
    return last.select("item_key", "event_id", "event_type", F.get_json_object("details_json", "$.version").try_cast("int").alias("version"))


def watermark_keys(spark: SparkSession, base: str) -> DataFrame:
    """The newest date of the old state and the items at it."""
    old = latest_items(spark, base, ["date_added"]).where(F.col("date_added") < F.lit(CUT).cast("timestamp"))
    return incremental.watermark(old.select("item_key", "date_added"), "date_added", "item_key")


def watermark_new_items(spark: SparkSession, base: str) -> DataFrame:
    """Items newer than the watermark, or at it and not seen."""
    items = latest_items(spark, base, ["date_added", "title"]).select("item_key", "date_added", "title")
    return incremental.newer_than(items, watermark_keys(spark, base), "date_added", "item_key").select("item_key", "date_added", "title")


def late_events(spark: SparkSession, base: str) -> DataFrame:
    """Delay of detection in days, by event type and day bucket."""
    days = F.floor((F.unix_timestamp("detected_at") - F.unix_timestamp("event_at")) / 86400)
    return events(spark, base).select("event_type", days.alias("days_late")).groupBy("event_type", "days_late").agg(F.count("*").alias("n_events"))


def event_windows(spark: SparkSession, base: str) -> DataFrame:
    """Events per day and type in event time."""
    counts = incremental.windowed_counts(events(spark, base), "event_at", "1 day", ["event_type"])
    return counts.select(F.col("window.start").alias("day"), "event_type", "n_events")


def upserted_items(spark: SparkSession, base: str) -> DataFrame:
    """Old state and new rows merged: new cells win, the first sight is kept."""
    rows = read_table(spark, base, "library_items").select("item_key", "version", "title", "first_seen_at", "last_synced_at")
    split = F.lit(CUT).cast("timestamp")
    old = merge.last_rows(rows.where(F.col("last_synced_at") < split), ["item_key"], ["version", "last_synced_at"])
    new = merge.last_rows(rows.where(F.col("last_synced_at") >= split), ["item_key"], ["version", "last_synced_at"])
    return merge.upsert(old, new, ["item_key"], keep_old=["first_seen_at"])


def change_events(spark: SparkSession, base: str) -> DataFrame:
    """new_item and updated_item events that the new rows would give."""
    rows = read_table(spark, base, "library_items").select("item_key", "version", "date_modified", "last_synced_at")
    split = F.lit(CUT).cast("timestamp")
    old = merge.last_rows(rows.where(F.col("last_synced_at") < split), ["item_key"], ["version", "last_synced_at"])
    new = merge.last_rows(rows.where(F.col("last_synced_at") >= split), ["item_key"], ["version", "last_synced_at"])
    return merge.change_events(old, new, "item_key", ["version", "date_modified"])


def scoped_replace(spark: SparkSession, base: str) -> DataFrame:
    """Texts of theses replaced by an empty state, all others kept."""
    rows = read_table(spark, base, "pdf_extraction").select("attachment_key", "item_key", "status").distinct()
    scope = latest_items(spark, base, ["item_type"]).where("item_type = 'thesis'").select("item_key")
    fresh = rows.join(scope, "item_key", "left_semi").select("attachment_key", "item_key", F.lit("missing").alias("status"))
    return merge.replace_scope(rows, fresh, scope, "item_key")


def sync_runs(spark: SparkSession, base: str) -> DataFrame:
    """One run per day of detection: start, last heartbeat, events; a day that ended with an error is left running."""
    rows = events(spark, base).withColumn("day", F.to_date("detected_at"))
    return rows.groupBy("day").agg(
        F.min("detected_at").alias("started_at"),
        F.max("detected_at").alias("heartbeat_at"),
        F.count("*").alias("items_seen"),
        F.count_if(F.col("event_type") == "sync_error").alias("n_errors"),
        F.when(F.max_by("event_type", F.struct("detected_at", "event_id")) == "sync_error", "running").otherwise("finished").alias("status"),
    )


def stale_runs(spark: SparkSession, base: str) -> DataFrame:
    runs = sync_runs(spark, base).withColumns({"finished_at": F.when(F.col("status") == "finished", F.col("heartbeat_at")), "note": F.lit("")})
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return merge.stale_runs(runs, now, 3600, "heartbeat lost").select("day", "status", "finished_at", "note", "items_seen")


def latest_runs(spark: SparkSession, base: str) -> DataFrame:
    """The last five runs: a top-k report."""
    return sync_runs(spark, base).select("day", "status", "items_seen", "n_errors").orderBy(F.desc("day")).limit(5)


def event_rates(spark: SparkSession, base: str) -> DataFrame:
    """Share of errors by month."""
    rows = events(spark, base).withColumn("month", F.date_format("event_at", "yyyy-MM"))
    return rows.groupBy("month").agg(F.count("*").alias("n_events"), F.round(F.avg((F.col("event_type") == "sync_error").cast("double")), 9).alias("error_rate"), F.count_distinct("item_key").alias("n_items"))


def busiest_items(spark: SparkSession, base: str) -> DataFrame:
    """The twenty items with most events: a top-k report over a skewed key."""
    return aggregate.top_k(events(spark, base).groupBy("item_key").agg(F.count("*").alias("n_events")), 20, "n_events", ["item_key"])


QUERIES = {
    f.__name__: f
    for f in (
        event_replays, state_fold, watermark_keys, watermark_new_items, late_events, event_windows, upserted_items, change_events, scoped_replace, sync_runs, stale_runs,
        latest_runs, event_rates, busiest_items,
    )
}

_EVENTS = "events AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY detected_at DESC) AS newest FROM item_events) WHERE newest = 1)"
_SPLIT = f"""
    old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY version DESC, last_synced_at DESC) AS p FROM library_items WHERE last_synced_at < TIMESTAMPTZ '{CUT}+00') WHERE p = 1),
    new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY version DESC, last_synced_at DESC) AS p FROM library_items WHERE last_synced_at >= TIMESTAMPTZ '{CUT}+00') WHERE p = 1)
"""
_MARK = f"mark AS (SELECT date_added AS at_time, item_key FROM latest WHERE date_added = (SELECT max(date_added) FROM latest WHERE date_added < TIMESTAMPTZ '{CUT}+00'))"
_RUNS = """
    runs AS (SELECT CAST(detected_at AT TIME ZONE 'UTC' AS DATE) AS day, min(detected_at) AS started_at, max(detected_at) AS heartbeat_at, count(*) AS items_seen, count_if(event_type = 'sync_error') AS n_errors,
      CASE WHEN arg_max(event_type, (detected_at, event_id)) = 'sync_error' THEN 'running' ELSE 'finished' END AS status FROM events GROUP BY day)
"""

ORACLES = {
    "event_replays": """SELECT event_type, count(*) AS n_events, count_if(times > 1) AS n_replayed, CAST(sum(times) AS BIGINT) AS n_rows FROM (
      SELECT event_id, count(*) AS times, min(event_type) AS event_type FROM item_events GROUP BY event_id) GROUP BY event_type""",
    "state_fold": f"""WITH {_EVENTS} SELECT item_key, event_id, event_type, TRY_CAST(json_extract_string(details_json, '$.version') AS INTEGER) AS version FROM (
      SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY event_at DESC, event_id DESC) AS place FROM events) WHERE place = 1""",
    "watermark_keys": f"WITH {_LATEST}, {_MARK} SELECT at_time, item_key FROM mark",
    "watermark_new_items": f"WITH {_LATEST}, {_MARK} SELECT item_key, date_added, title FROM latest WHERE date_added > (SELECT max(at_time) FROM mark) OR (date_added = (SELECT max(at_time) FROM mark) AND item_key NOT IN (SELECT item_key FROM mark))",
    "late_events": f"WITH {_EVENTS} SELECT event_type, CAST(floor((floor(epoch(detected_at)) - floor(epoch(event_at))) / 86400) AS BIGINT) AS days_late, count(*) AS n_events FROM events GROUP BY ALL",
    "event_windows": f"WITH {_EVENTS} SELECT date_trunc('day', event_at) AS day, event_type, count(*) AS n_events FROM events GROUP BY ALL",
    "upserted_items": f"""WITH {_SPLIT} SELECT coalesce(n.item_key, o.item_key) AS item_key, CASE WHEN n.item_key IS NOT NULL THEN n.version ELSE o.version END AS version, CASE WHEN n.item_key IS NOT NULL THEN n.title ELSE o.title END AS title,
      coalesce(o.first_seen_at, n.first_seen_at) AS first_seen_at, CASE WHEN n.item_key IS NOT NULL THEN n.last_synced_at ELSE o.last_synced_at END AS last_synced_at FROM old o FULL JOIN new n ON n.item_key = o.item_key""",
    "change_events": f"""WITH {_SPLIT} SELECT n.item_key, CASE WHEN o.item_key IS NULL THEN 'new_item' ELSE 'updated_item' END AS event_type FROM new n LEFT JOIN old o ON o.item_key = n.item_key
      WHERE o.item_key IS NULL OR n.version IS DISTINCT FROM o.version OR n.date_modified IS DISTINCT FROM o.date_modified""",
    "scoped_replace": f"""WITH {_LATEST}, held AS (SELECT DISTINCT attachment_key, item_key, status FROM pdf_extraction)
      SELECT attachment_key, h.item_key, CASE WHEN l.item_type = 'thesis' THEN 'missing' ELSE status END AS status FROM held h LEFT JOIN latest l ON l.item_key = h.item_key""",
    "sync_runs": f"WITH {_EVENTS}, {_RUNS} SELECT * FROM runs",
    "stale_runs": f"""WITH {_EVENTS}, {_RUNS} SELECT day, CASE WHEN stale THEN 'interrupted' ELSE status END AS status,
      CASE WHEN status = 'finished' THEN heartbeat_at WHEN stale THEN TIMESTAMPTZ '2025-01-01 00:00:00+00' END AS finished_at, CASE WHEN stale THEN 'heartbeat lost' ELSE '' END AS note, items_seen
      FROM (SELECT *, status = 'running' AND epoch(TIMESTAMPTZ '2025-01-01 00:00:00+00') - floor(epoch(heartbeat_at)) > 3600 AS stale FROM runs)""",
    "latest_runs": f"WITH {_EVENTS}, {_RUNS} SELECT day, status, items_seen, n_errors FROM runs ORDER BY day DESC LIMIT 5",
    "event_rates": f"WITH {_EVENTS} SELECT strftime(event_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_events, round(avg(CAST(event_type = 'sync_error' AS DOUBLE)), 9) AS error_rate, count(DISTINCT item_key) AS n_items FROM events GROUP BY month",
    "busiest_items": f"WITH {_EVENTS} SELECT item_key, count(*) AS n_events FROM events GROUP BY item_key ORDER BY n_events DESC, item_key LIMIT 20",
}
