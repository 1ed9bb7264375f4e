"""Paragraphs and sections of text as Column expressions; nothing here leaves the JVM but ``repair_encoding``.

A text is never walked line by line. Its lines are marked, joined again into one string with two control
characters (``SOFT`` where a line may go on, ``HARD`` where a block ends), and the rules of joining are
patterns over that string.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from marginalia.functions.scalars import text_of
from marginalia.functions.text import ColumnOrName, let, trim_ws

SOFT, HARD = "\u0001", "\u0002"

#: Lines that are a paragraph of their own, as patterns of whole lines.
ALONE = {
    "page": r"=+ ?page \d+\b[^=]*=+",
    "bullet": r"[-*+•] .*",
    "number": r"\(?\d+[.)] .*",
    "letter": r"[a-z][.)] .*",
}
#: Scripts that are written without blanks.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
#: Characters that follow, or are followed by, text without a blank.
CLOSING, OPENING = ",.;:!?)]}%，。；：！？、）】》", "([{《【"


def _class(characters: str) -> str:
    return "[" + "".join("\\" + c if c in "[]\\^-" else c for c in characters) + "]"


#: How a line goes on in the next one: pattern of the place, and what stands there; the first that fits counts.
JOINS = [
    (rf"-{SOFT}(?=[a-z])", ""),
    (rf"(?<=[{UNSPACED}]){SOFT}(?=[{UNSPACED}])", ""),
    (rf"{SOFT}(?={_class(CLOSING)})|(?<={_class(OPENING)}){SOFT}", ""),
    (SOFT, " "),
]


def _lines(x: ColumnOrName) -> Column:
    """Lines whatever ends them, white space compacted; control characters that serve as marks here are dropped."""
    plain = F.translate(text_of(x), SOFT + HARD, "")
    return F.transform(F.split(plain, r"\r\n|\n|\r"), lambda v: F.regexp_replace(trim_ws(v), r"(?U)\s+", " "))


def reflow_text(x: ColumnOrName) -> Column:
    """Lines to paragraphs: blank lines part them, page lines and list items stand alone; null gives an empty text."""
    alone = "(?i)^(?:" + "|".join(ALONE.values()) + ")$"
    marked = F.transform(
        _lines(x), lambda v: F.when(v == "", F.lit(HARD)).when(v.rlike(alone), F.concat(F.lit(HARD), v, F.lit(HARD))).otherwise(F.concat(v, F.lit(SOFT)))
    )
    joined = F.regexp_replace(F.array_join(marked, ""), rf"{SOFT}(?={HARD}|$)", "")
    for place, stands in JOINS:
        joined = F.regexp_replace(joined, place, stands)
    blocks = F.filter(F.split(joined, HARD), lambda b: b != "")
    return let(F.array_join(blocks, "\n\n"), lambda t: F.when(t == "", t).otherwise(F.concat(t, F.lit("\n"))))


#: Headings, one group each: Markdown's, and HTML's on a line of its own.
HEADINGS = [r"#{1,6}[ \t]+(\S.*?)", r"<h[1-6]\b[^>\n]*>(.*?)</h[1-6]>"]


def heading_title(x: ColumnOrName) -> Column:
    """A heading without tags, signs and numbers in front."""
    bare = F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", ""), r"^[^\p{L}\p{N}]+", "")
    return trim_ws(F.regexp_replace(bare, r"^\d+(?:\.\d+)*\.?\s+", ""))


def section_list(x: ColumnOrName) -> Column:
    """(heading, body) for each distinct heading in order: its lines joined by blanks, blank lines and those with ? alone dropped.

    Text before the first heading and below a heading without a title belongs to no section.
    """
    plain = F.regexp_replace(F.translate(text_of(x), SOFT + HARD, ""), r"\r\n?", "\n")
    groups = "".join(f"${k}" for k in range(1, len(HEADINGS) + 1))
    parts = F.split(F.regexp_replace(plain, rf"(?m)^(?:{'|'.join(HEADINGS)})[ \t]*$", HARD + groups + SOFT), HARD)
    cells = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(heading_title(F.substring_index(p, SOFT, 1)).alias("heading"), F.filter(F.transform(F.split(F.substring_index(p, SOFT, -1), "\n"), trim_ws), lambda v: ~v.isin("", "?")).alias("lines")),
    )

    def merged(titled: Column) -> Column:
        lines = lambda h: F.flatten(F.transform(F.filter(titled, lambda c: c["heading"] == h), lambda c: c["lines"]))
        return F.transform(F.array_distinct(F.transform(titled, lambda c: c["heading"])), lambda h: F.struct(h.alias("heading"), F.array_join(lines(h), " ").alias("body")))

    return let(F.filter(cells, lambda c: c["heading"] != ""), merged)


def section_map(x: ColumnOrName) -> Column:
    return F.map_from_entries(section_list(x))


def unmangle(text: str | None) -> str | None:
    """Text that was UTF-8 read as GBK, read again; other text stays."""
    try:
        return text.encode("gbk").decode("utf-8") or text if text else text
    except UnicodeError:
        return text


@F.pandas_udf(StringType())
def repair_encoding(texts: pd.Series) -> pd.Series:
    """Spark's encoders know no GBK that fails on bad characters, so this one works on Arrow batches."""
    return texts.map(unmangle)
