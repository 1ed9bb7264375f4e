"""Search over items and the texts of their attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Item types that are no literature of their own.
CHILD_TYPES = ["attachment", "note", "annotation"]


def not_deleted(items: DataFrame) -> DataFrame:
    return items.where(F.coalesce("zotero_deleted", F.lit(0)) == 0)


def search(items: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Items with the needle in any of the columns, case ignored; the needle is literal."""
    wanted = needle.lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(wanted)
    return not_deleted(items).where(hit)


def context_order() -> list[Column]:
    return [F.desc_nulls_last("year"), F.lower("title"), F.asc("item_key")]


def status_rank(status: Column) -> Column:
    return F.when(status == "ok", 0).when(status == "needs_ocr", 1).when(status == "missing", 2).otherwise(3)


def best_text(texts: DataFrame) -> DataFrame:
    """One text per item: the best status, then the longest, then the first key; partial minima are taken before the shuffle."""
    ranked = F.struct(status_rank(F.col("status")).alias("r"), (-F.col("n_chars")).alias("c"), "attachment_key", "status", "n_chars")
    return texts.groupBy("item_key").agg(F.min(ranked).alias("_b")).select("item_key", "_b.attachment_key", "_b.status", "_b.n_chars")


def ranked_texts(texts: DataFrame) -> DataFrame:
    """Texts of an item numbered by status, length and key."""
    order = Window.partitionBy("item_key").orderBy(status_rank(F.col("status")), F.desc("n_chars"), "attachment_key")
    return texts.withColumn("place", F.row_number().over(order))


def needs_ocr(texts: DataFrame, skip_types: list[str], most_pages: int) -> Column:
    """Eligible for recognition: marked so, item type not skipped, page count unknown or small enough."""
    pages = F.coalesce("pages_total", F.lit(0))
    return (F.col("status") == "needs_ocr") & ~F.coalesce("item_type", F.lit("")).isin(skip_types) & ((pages == 0) | (pages <= most_pages))
