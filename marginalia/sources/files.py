"""File sources as DataFrames: CSV, JSON lines, Markdown cards and tables, plain text, DOCX, PDF."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.functions.scalars import text_of
from marginalia.functions.text import trim_ws


def read_csv(spark: SparkSession, path: str, fields: list[str] | None = None, required: list[str] | None = None, line_breaks: bool = True) -> DataFrame:
    """All-string CSV with a header; a byte order mark in front of it doesn't count.

    Cells may hold line breaks; a file is one task then. Without them (``line_breaks=False``) files are split.

    ``required`` columns must be there. With ``fields``, other columns are dropped and missing ones are empty.
    """
    rows = spark.read.csv(path, header=True, multiLine=line_breaks, escape='"', inferSchema=False)
    rows = rows.toDF(*(c.lstrip("\ufeff") for c in rows.columns))
    lacking = sorted(set(required or []) - set(rows.columns))
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    if fields is None:
        return rows
    return rows.select(*(F.coalesce(F.col(f"`{f}`"), F.lit("")).alias(f) if f in rows.columns else F.lit("").alias(f) for f in fields))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; a bad line fails the scan, or is left out if not strict."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_json_items(spark: SparkSession, path: str, schema: str, field: str = "items") -> DataFrame:
    """The objects in one list of a JSON document."""
    return spark.read.schema(f"{field} array<{schema}>").json(path, multiLine=True).select(F.explode(field).alias("_i")).select("_i.*")


def read_texts(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, name, text): whole files below a folder, hidden ones and those that begin with _ left out."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    named = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return named.where(~F.col("name").rlike(r"^[_.]") & (F.lower("name") != "readme.md"))


def flat_metadata(block: Column) -> Column:
    """``key: value`` lines as a map; comments and blank lines don't count, the last of a key does, quotes around values are dropped."""
    lines = F.filter(F.split(text_of(block), r"\r?\n"), lambda x: x.contains(":") & ~trim_ws(x).startswith("#"))
    entries = F.transform(
        lines, lambda x: F.struct(trim_ws(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(trim_ws(F.regexp_replace(x, r"^[^:]*:", "")), r"^[\x22\x27]+|[\x22\x27]+$", "").alias("value"))
    )
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(kept)


def card_metadata(text: Column, heading: str = "Machine metadata") -> Column:
    """Metadata of a card: the fenced block under a tail heading, overridden by the front matter."""
    front = F.regexp_extract(text, r"(?s)\A\ufeff?---\r?\n(.*?)\r?\n---", 1)
    tail = F.regexp_extract(text, rf"(?s)\n#+ {heading}\s*\n+```[a-z]*\r?\n(.*?)\r?\n```", 1)
    top, bottom = flat_metadata(front), flat_metadata(tail)
    return F.map_concat(F.map_filter(bottom, lambda k, v: ~F.map_contains_key(top, k)), top)


def metadata_block(fields: Column) -> Column:
    """A map as ``key: value`` lines in the order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(k, F.lit(": "), text_of(F.element_at(fields, k)))), "\n")


def with_metadata(text: Column, fields: Column, place: str = "tail", heading: str = "Machine metadata") -> Column:
    """A card with its metadata written anew: the front matter or the block under the tail heading; added where there was none."""
    body, block = text_of(text), metadata_block(fields)
    if place == "front":
        rest = F.regexp_replace(body, r"(?s)\A\ufeff?---\r?\n.*?\r?\n---(?:\r?\n|\z)", "")
        return F.concat(F.lit("---\n"), block, F.lit("\n---\n"), rest)
    bare = F.regexp_replace(body, rf"(?s)\s*\n#+ {heading}\s*\n+```[a-z]*\r?\n.*?\r?\n```[ \t]*", "")
    return F.concat(F.regexp_replace(bare, r"\s+\z", ""), F.lit(f"\n\n## {heading}\n\n```yaml\n"), block, F.lit("\n```\n"))


def seeded(spark: SparkSession, keys: list[str], column: str = "item_key") -> DataFrame:
    """The distinct keys of a request as rows, where no cards are there to start from."""
    return spark.createDataFrame([(k,) for k in sorted(set(keys))], f"{column} string")


def given_or(spark: SparkSession, path: str | None, schema: str, live: Callable[[], DataFrame]) -> DataFrame:
    """Rows of a JSON lines file if one is given, else what a live look-up finds."""
    return read_jsonl(spark, path, schema) if path else live()


def markdown_table(text: Column, columns: list[str]) -> Column:
    """Rows of the tables in a Markdown text that begin with a linked key, as structs: the key, then the cells behind it."""
    lines = F.filter(F.split(text_of(text), r"\r?\n"), lambda x: x.rlike(r"^\s*\|\s*\[([A-Z0-9]{8})\]\([^)]*\b\1\)"))

    def row(line: Column) -> Column:
        cells = F.transform(F.split(F.regexp_replace(trim_ws(line), r"^\||\|$", ""), r"(?<!\\)\|"), trim_ws)
        key = F.regexp_extract(cells[0], r"\[([A-Z0-9]{8})\]", 1)
        return F.struct(key.alias("key"), *(F.coalesce(F.get(cells, F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(columns, 1)))

    return F.transform(lines, row)


ENCODINGS = ("utf-8-sig", "gb18030")


def decode(raw: bytes) -> str:
    """Text in the first encoding that fits; else UTF-8 with signs for what is broken."""
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(raw: bytes) -> str:
    """Paragraphs of a word file, one a line; empty ones are left out, tabs stay."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    out = []
    for paragraph in body.iter(f"{_W}p"):
        text = "".join(x.text or "" if x.tag == f"{_W}t" else "\t" for x in paragraph.iter() if x.tag in (f"{_W}t", f"{_W}tab"))
        if text.strip():
            out.append(text)
    return "\n".join(out)


def pdf_text(raw: bytes) -> tuple[str, int]:
    """Text of a PDF with page lines and its number of pages; needs the optional package pypdf."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("pypdf is not installed") from e
    pages = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(raw)).pages]
    return "\n\n".join(f"===== Page {k} =====\n\n{t.strip()}" for k, t in enumerate(pages, 1)), len(pages)


def extraction_state(text: str) -> str:
    """needs_ocr if pages hold fewer than a hundred characters, else ok."""
    return "ok" if len(re.sub(r"===== Page \d+ =====|\s", "", text)) >= 100 else "needs_ocr"


def read_materials(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, status, text, pages, error): every TXT, MD, DOCX and PDF file below a folder; a bad file is a row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    wanted = files.select("path", kind.alias("kind"), "content").where(F.col("kind").isin("txt", "md", "docx", "pdf") & ~F.col("path").rlike(r"/\.[^/]"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, kind, content in zip(frame.path, frame.kind, frame.content):
                text, pages, error = "", 0, ""
                try:
                    if kind == "pdf":
                        text, pages = pdf_text(bytes(content))
                    else:
                        text = docx_text(bytes(content)) if kind == "docx" else decode(bytes(content))
                except Exception as e:  # noqa: BLE001 - a bad file is a row
                    error = f"{type(e).__name__}: {e}"[:500]
                rows.append((path, kind, "error" if error else extraction_state(text) if kind == "pdf" else "ok", text, pages, error))
            yield pd.DataFrame(rows, columns=["path", "kind", "status", "text", "pages", "error"])

    return wanted.mapInPandas(run, "path string, kind string, status string, text string, pages int, error string")
