"""Sinks: CSV, JSON lines, event logs, partitioned tables, packets and small reports."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions.scalars import text_of


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """The listed fields as strings, missing ones empty; one folder of part files with headers."""
    shown = [text_of(f"`{f}`").alias(f) if f in rows.columns else F.lit("").alias(f) for f in fields]
    rows.select(*shown).write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_json(rows: DataFrame, path: str, head: dict[str, str] | None = None, field: str = "items") -> None:
    """One indented JSON document: the head's values and the rows as a list; for reports, so the rows are bounded."""
    document = {**(head or {}), field: [json.loads(r.line) for r in _report_rows(rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")))]}
    text = json.dumps(document, ensure_ascii=False, indent=2)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_events(rows: DataFrame, path: str, defaults: dict[str, str]) -> None:
    """Full event rows appended to a log; columns that are missing get their default."""
    rows.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in rows.columns}).write.mode("append").json(path)


#: Files of a topic, at most.
TOPIC_FILES = 32


def write_by_topic(rows: DataFrame, topics: DataFrame, key: str, path: str) -> None:
    """One partition per topic; a row may be in several. Partitions of topics that are gone go too."""
    # rows of a large topic are written by several tasks, by their key
    rows.join(topics, key).repartition("topic", F.pmod(F.xxhash64(key), F.lit(TOPIC_FILES))).write.mode("overwrite").partitionBy("topic").parquet(path)


def write_texts(rows: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Texts by (item_key, attachment_key) added to a Parquet cache; returns counts by outcome.

    Outcomes: skipped (no text), linked_existing (there already), exported.
    """
    spark = rows.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    keys = ["item_key", "attachment_key"]
    held = spark.read.parquet(path).select(*keys).distinct().withColumn("_held", F.lit(True)) if there and not overwrite else rows.select(*keys).limit(0).withColumn("_held", F.lit(True))
    judged = rows.join(held, keys, "left").withColumn("outcome", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "skipped").when(F.col("_held"), "linked_existing").otherwise("exported"))
    counts = judged.groupBy("outcome").agg(F.count("*").alias("n")).collect()  # three rows at most
    judged.where("outcome = 'exported'").select(*keys, "text").write.mode("overwrite" if overwrite else "append").parquet(path)
    return spark.createDataFrame([tuple(r) for r in counts], "outcome string, n long")


def packet(title: Column, fields: dict[str, Column], body: Column) -> Column:
    """One Markdown section per record."""
    facts = F.concat_ws("\n", *(F.concat(F.lit(f"- {name}: "), text_of(value)) for name, value in fields.items()))
    return F.concat(F.lit("## "), text_of(title), F.lit("\n\n"), facts, F.lit("\n\n"), text_of(body), F.lit("\n"))


REPORT_ROWS = 10_000


def _report_rows(rows: DataFrame) -> list:
    """Rows of a report that is formatted on the driver; more than a page can show is an error."""
    found = rows.limit(REPORT_ROWS + 1).collect()
    if len(found) > REPORT_ROWS:
        raise ValueError(f"a report shows {REPORT_ROWS} rows at most; aggregate first")
    return found


def markdown_report(rows: DataFrame) -> str:
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in _report_rows(rows))]) + "\n"


def html_report(rows: DataFrame, title: str) -> str:
    cells = lambda tag, vs: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in vs) + "</tr>"
    body = "\n".join([cells("th", rows.columns), *(cells("td", r) for r in _report_rows(rows))])
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title>\n<table>\n{body}\n</table>\n"
