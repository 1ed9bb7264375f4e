"""Scalar functions of the library's cells as Column expressions.

All of them take null as an empty cell and run inside the JVM; the three that need a line machine or a
character set are Arrow UDFs in ``marginalia.functions.paragraphs``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marginalia.functions.text import ColumnOrName, as_col, is_known, trim_ws

LETTERS_DIGITS = "A-Z0-9"


def text_of(x: ColumnOrName) -> Column:
    return F.coalesce(as_col(x).cast("string"), F.lit(""))


def clean_text(x: ColumnOrName) -> Column:
    """Text with a sign for whatever is no valid character: bytes that are no UTF-8, and halves of surrogate pairs that bytes may spell."""
    return F.make_valid_utf8(text_of(x))


def split_list(x: ColumnOrName, separators: str = ";", lower: bool = False) -> Column:
    """Trimmed non-empty parts in order, repeats kept; an unknown cell has none."""
    source = F.lower(text_of(x)) if lower else text_of(x)
    parts = F.filter(F.transform(F.split(source, f"[{separators}]+"), trim_ws), lambda p: p != "")
    return F.when(is_known(x), parts).otherwise(F.array().cast("array<string>"))


def inline_list(x: ColumnOrName) -> Column:
    """Values of ``[a, "b"]``; any other cell is split on semicolon, bar, comma and slash, in lower case."""
    inner = F.regexp_replace(trim_ws(x), r"^\[|\]$", "")
    listed = F.filter(F.transform(F.split(inner, ","), lambda p: F.regexp_replace(trim_ws(p), r"^[\x22\x27]+|[\x22\x27]+$", "")), lambda p: p != "")
    return F.when(trim_ws(x).rlike(r"^\[.*\]$"), listed).otherwise(split_list(x, r";|,/", lower=True))


def first_known(*xs: ColumnOrName) -> Column:
    """The first known value, trimmed; empty if there is none."""
    return F.coalesce(*(F.when(is_known(x), trim_ws(x)) for x in xs), F.lit(""))


def normalize_scalar(x: ColumnOrName) -> Column:
    return F.lower(trim_ws(text_of(x)))


def key_upper(x: ColumnOrName) -> Column:
    return F.upper(trim_ws(text_of(x)))


def item_key(x: ColumnOrName) -> Column:
    """The 8-character key of an ``items/KEY`` link, a ``[KEY](...)`` link or a bare key, in capitals; else empty."""
    plain = F.regexp_replace(trim_ws(text_of(x)), r"^[\x22\x27]+|[\x22\x27]+$", "")
    found = (
        F.regexp_extract(plain, rf"(?i)items/([{LETTERS_DIGITS}]{{8}})", 1),
        F.regexp_extract(plain, rf"\[([{LETTERS_DIGITS}]{{8}})\]\([a-z]+://select/library/items/[{LETTERS_DIGITS}]{{8}}\)", 1),
        F.regexp_extract(plain, rf"^([{LETTERS_DIGITS}]{{8}})$", 1),
    )
    return F.upper(F.coalesce(*(F.when(f != "", f) for f in found), F.lit("")))


def attachment_key(*xs: ColumnOrName) -> Column:
    """The first attachment key in any of the cells: bare, or behind 'attachment key' or 'pdf'."""
    tries = []
    for x in xs:
        plain = trim_ws(text_of(x))
        for pattern in (
            rf"(?i)^([{LETTERS_DIGITS}]{{8}})$",
            rf"(?i)attachment[_\s-]*key[:\s`\x22\x27]+([{LETTERS_DIGITS}]{{8}})",
            rf"(?i)\bpdf\s+([{LETTERS_DIGITS}]{{8}})\b",
        ):
            found = F.regexp_extract(plain, pattern, 1)
            tries.append(F.when(is_known(x) & (found != ""), found))
    return F.coalesce(*tries, F.lit(""))


def year_of(x: ColumnOrName) -> Column:
    """The first token of four digits between - / and ., else four digits at the start, else empty."""
    tokens = F.filter(F.split(text_of(x), r"[-/.]"), lambda t: t.rlike(r"^\d{4}$"))
    return F.when(F.size(tokens) > 0, F.get(tokens, F.lit(0))).when(text_of(x).rlike(r"^\d{4}"), F.substring(text_of(x), 1, 4)).otherwise("")


def creators_text(x: ColumnOrName) -> Column:
    """Names of a creator list joined by semicolons: ``name``, else first and last name."""
    listed = F.from_json(as_col(x), "array<struct<name:string, firstName:string, lastName:string>>")
    names = F.transform(
        F.coalesce(listed, F.array().cast("array<struct<name:string, firstName:string, lastName:string>>")),
        lambda c: F.when(F.coalesce(c["name"], F.lit("")) != "", trim_ws(c["name"])).otherwise(
            F.trim(F.concat_ws(" ", F.coalesce(c["firstName"], F.lit("")), F.coalesce(c["lastName"], F.lit(""))))
        ),
    )
    return F.array_join(F.filter(names, lambda n: n != ""), "; ")


def citation_label(creators: ColumnOrName, year: ColumnOrName) -> Column:
    """``Last(year)`` of the first creator; Unknown and n.d. where missing."""
    first = F.split(trim_ws(F.substring_index(text_of(creators), ";", 1)), r"\s+")
    last = F.get(first, F.size(first) - 1)
    return F.concat(F.when(last == "", "Unknown").otherwise(last), F.lit("("), F.when(text_of(year) == "", "n.d.").otherwise(text_of(year)), F.lit(")"))


def slug(x: ColumnOrName) -> Column:
    """Lower case with ASCII letters and digits joined by hyphens; 'unclassified' if none are left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(trim_ws(text_of(x))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(plain == "", "unclassified").otherwise(plain)


def text_blob(*xs: ColumnOrName) -> Column:
    """Non-empty cells joined by blanks, in lower case."""
    return F.lower(F.concat_ws(" ", *(F.when(text_of(x) != "", text_of(x)) for x in xs)))


def compact_token(x: ColumnOrName) -> Column:
    return F.regexp_replace(F.lower(text_of(x)), r"[^a-z0-9]+", "")


def tag_namespace(x: ColumnOrName) -> Column:
    """What stands before the first slash of a tag, an opening # left out; empty if there is no slash."""
    return F.when(text_of(x).contains("/"), F.regexp_replace(F.substring_index(text_of(x), "/", 1), r"^#", "")).otherwise("")


def tag_value(x: ColumnOrName) -> Column:
    return F.when(text_of(x).contains("/"), trim_ws(F.regexp_replace(text_of(x), r"^[^/]*/", ""))).otherwise(trim_ws(text_of(x)))


def normalize_tags(x: ColumnOrName, prefix: str, most: int) -> Column:
    """Tags without leading # and /, given the prefix where it is missing, without repeats, the first ``most``."""
    bare = F.filter(F.transform(as_col(x), lambda t: F.regexp_replace(trim_ws(t), r"^[#/]+", "")), lambda t: t != "")
    return F.slice(F.array_distinct(F.transform(bare, lambda t: F.when(t.startswith(prefix), t).otherwise(F.concat(F.lit(prefix), t)))), 1, most)


def display_width(x: ColumnOrName) -> Column:
    """Columns on a screen: two for every character beyond ASCII."""
    return F.length(text_of(x)) + F.length(F.regexp_replace(text_of(x), r"[\x00-\x7F]", ""))


def compact_authors(authors: ColumnOrName, corresponding: ColumnOrName) -> Column:
    """The first author, then the corresponding one; or the first two."""
    parts, others = split_list(authors, r";,|"), split_list(corresponding, r";,|")
    chosen = F.when(F.size(others) > 0, F.slice(F.array_distinct(F.concat(F.slice(parts, 1, 1), others)), 1, 2)).otherwise(F.slice(parts, 1, 2))
    return F.when(F.size(parts) == 0, trim_ws(text_of(authors))).otherwise(F.array_join(chosen, "; "))


def compact_whitespace(x: ColumnOrName) -> Column:
    """Line ends unified, runs of blanks to one, three or more line ends to two, trimmed."""
    unified = F.regexp_replace(text_of(x), r"\r\n?", "\n")
    return trim_ws(F.regexp_replace(F.regexp_replace(unified, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def compact_text(x: ColumnOrName, most: int) -> Column:
    """Line ends unified, four or more to three, cut to ``most`` characters, right-trimmed."""
    unified = F.regexp_replace(F.regexp_replace(text_of(x), r"\r\n?", "\n"), r"\n{4,}", "\n\n\n")
    return F.regexp_replace(F.substring(unified, 1, most), r"(?U)\s+$", "")


PAGE_LINE = r"(?m)^===== Page \d+ =====[ \t]*$"


def first_page(x: ColumnOrName, most: int) -> Column:
    """Text between the first and second page line, or all of it if there is none."""
    unified = F.regexp_replace(text_of(x), r"\r\n?", "\n")
    parts = F.split(unified, PAGE_LINE)
    page = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(unified)
    return F.regexp_replace(F.substring(compact_whitespace(page), 1, most), r"(?U)\s+$", "")


def first_pages(x: ColumnOrName, pages: int) -> Column:
    """Pages numbered up to ``pages`` with their page lines; all text if it has no page line."""
    parts = F.split(text_of(x), r"(?m)(?=^===== Page \d+ =====[ \t]*$)")
    marked = F.filter(parts, lambda p: p.rlike(r"^===== Page \d+ =====[ \t]*(\n|$)"))
    kept = F.filter(marked, lambda p: F.regexp_extract(p, r"^===== Page (\d+) =====", 1).try_cast("int") <= pages)
    return F.when(F.size(marked) == 0, text_of(x)).otherwise(F.array_join(F.transform(kept, trim_ws), "\n\n"))


def item_link(x: ColumnOrName, scheme: str) -> Column:
    """Markdown link to an item; empty without a key."""
    key = item_key(x)
    return F.when(key == "", "").otherwise(F.concat(F.lit("["), key, F.lit(f"]({scheme}://select/library/items/"), key, F.lit(")")))


def html_escape(x: ColumnOrName) -> Column:
    out = text_of(x)
    for wrong, right in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def markdown_escape(x: ColumnOrName) -> Column:
    """A cell of a Markdown table: bars escaped, line ends as blanks."""
    return F.regexp_replace(F.replace(text_of(x), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def portable_path(x: ColumnOrName, root: str) -> Column:
    """The part of a path behind the last ``root``, slashes unified; other paths stay."""
    unified = F.replace(text_of(x), F.lit("\\"), F.lit("/"))
    return F.when(unified.contains(f"/{root}/"), F.concat(F.lit(f"{root}/"), F.substring_index(unified, f"/{root}/", -1))).otherwise(unified)


def rank_map(x: ColumnOrName) -> Column:
    """``key: value; key: value`` as a map, keys in lower case, unknown values dropped, the last of a key counts."""
    pairs = F.filter(F.split(text_of(x), ";"), lambda p: p.contains(":"))
    entries = F.transform(
        pairs,
        lambda p: F.struct(F.lower(trim_ws(F.substring_index(p, ":", 1))).alias("key"), F.regexp_replace(p, r"^[^:]*:\s*|\s+$", "").alias("value")),
    )
    entries = F.filter(entries, lambda e: (e["key"] != "") & is_known(e["value"]))
    # of equal keys the last one stays, whatever the session's policy on duplicates is
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(kept)


def rank_text(ranks: Column, order: list[str]) -> Column:
    """A rank map as text, in a fixed order of its keys."""
    return F.concat_ws("; ", *(F.when(is_known(ranks[key]), F.concat(F.lit(f"{key}: "), ranks[key])) for key in order))


def clean_rank(x: ColumnOrName) -> Column:
    """White space out, separators unified, none of them at either end."""
    joined = F.regexp_replace(F.regexp_replace(text_of(x), r"(?U)\s+", ""), r"[;；,，/|]+", "、")
    return F.regexp_replace(F.regexp_replace(joined, r"^[：:、]+|[：:、]+$", ""), r"、{2,}", "、")


def json_strings(x: ColumnOrName) -> Column:
    """A JSON list of strings as an array; empty for anything else."""
    return F.coalesce(F.from_json(as_col(x), "array<string>"), F.array().cast("array<string>"))


def known_strings(x: ColumnOrName) -> Column:
    """Trimmed non-empty strings of a JSON list, repeats kept."""
    return F.filter(F.transform(json_strings(x), trim_ws), lambda v: v.isNotNull() & (v != ""))


def numeric_year(x: ColumnOrName) -> Column:
    return year_of(x).try_cast("int")


def file_url_path(x: ColumnOrName) -> Column:
    """A path from a file URL: decoded, drive letters and network shares as Windows writes them; other text stays."""
    url = trim_ws(text_of(x))
    rest = F.url_decode(F.regexp_replace(F.regexp_replace(url, r"(?i)^file:/*", ""), r"\+", "%2B"))
    share = F.regexp_extract(url, r"(?i)^file://([^/]+)/", 1)
    path = F.when(rest.rlike(r"^[A-Za-z]:/"), rest).when((share != "") & (F.lower(share) != "localhost"), F.concat(F.lit("//"), rest)).otherwise(F.concat(F.lit("/"), rest))
    return F.when(url.rlike(r"(?i)^file:/"), path).otherwise(url)


def name_parts(x: ColumnOrName) -> Column:
    """``code-one-two`` as (code, first, second, raw): two splits at most, missing parts empty."""
    parts = F.split(text_of(x), "-", 3)
    at = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    return F.struct(at(0).alias("code"), at(1).alias("first"), at(2).alias("second"), text_of(x).alias("raw"))


def short_code(x: ColumnOrName) -> Column:
    """Capital letters and digits, eight at most; UNK without any."""
    code = F.substring(F.regexp_replace(F.upper(text_of(x)), r"[^A-Z0-9]+", ""), 1, 8)
    return F.when(code == "", "UNK").otherwise(code)


def last_segment(x: ColumnOrName) -> Column:
    return F.regexp_extract(trim_ws(text_of(x)), r"([^/]*)/*$", 1)


def first_words(x: Column) -> Column:
    """The first word of each entry of a list."""
    return F.filter(F.transform(x, lambda v: F.regexp_extract(trim_ws(v), r"^(\S+)", 1)), lambda v: v != "")


def clean_section(x: ColumnOrName) -> Column:
    """Lines joined by blanks, blank lines and those with ? alone dropped."""
    lines = F.filter(F.transform(F.split(text_of(x), r"\r?\n"), trim_ws), lambda v: ~v.isin("", "?"))
    return F.array_join(lines, " ")


def should_extract(status: Column, old_print: Column, new_print: Column, force: bool, recognise: bool) -> Column:
    """Whether a file's text is to be extracted: forced, new, waiting for recognition that is on, or changed."""
    changed = F.coalesce((old_print != "") & (new_print != "") & (old_print != new_print), F.lit(False))
    return (
        F.lit(force)
        | status.isNull()
        | F.coalesce((status == "needs_ocr") & F.lit(recognise), F.lit(False))
        | (F.coalesce(~status.isin("error", "needs_ocr", "missing"), F.lit(True)) & changed)
    )
