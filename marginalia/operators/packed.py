"""Several values packed in one cell, to one row per value with its position.

A cell is split on its quote character. Odd pieces are literals and are kept whole; even pieces are
split on delimiters. A fold over the pieces reassembles the values: the first part of a piece goes on
with the value before it, every further part starts a new one. Everything is SQL array functions.

Defined results: null, empty and placeholder cells give no rows; empty values don't count; a quote
that isn't closed is an ordinary character; repeated rows count once; repeats of a value keep their
own positions; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from marginalia.functions.sql import sql
from marginalia.functions.text import UNKNOWN

#: How an even piece becomes an array of parts, by the kind of a cell.
PARTS = {
    "tags": r"split(piece, r'[;；,，|、\t\r\n]+|\s/\s')",
    # an address keeps its commas; an enumeration mark begins a new one
    "addresses": r"split(regexp_replace(piece, r'(?<=\S)\s+(?=\(\d+\)\s*\p{Lu})|(?<=\S)\s+(?=[a-z]\s+\p{Lu}\p{Ll})|(?<=\p{L})\s+(?=\d{1,2}[.]?\s+\p{Lu}\p{Ll})|(?<=\S)\s*(?=[¹²³⁴⁵⁶⁷⁸⁹])', '\n'), r'[;；|\t\r\n]+|\s/\s')",
    # a comma between two single words joins "Last, First"; Han names may be parted by blanks
    "names": r"""flatten(transform(split(piece, r'[;；|、，\t\r\n]+|\s*/\s*|,?\s+(?:and|&)\s+'), s -> CASE
        WHEN s RLIKE r'^\s*[\p{IsHan}·]+(\s+[\p{IsHan}·]+)+\s*$' THEN split(s, r'(?<=\p{IsHan})\s+(?=\p{IsHan})')
        WHEN NOT contains(s, ',') THEN array(s)
        WHEN s RLIKE r'^\s*[\p{IsLatin}.\x27’-]+,\s*[\p{IsLatin}.\x27’ -]+$' THEN array(s)
        WHEN s RLIKE r'^\s*[\p{IsLatin}.\x27’-]+(,\s*[\p{IsLatin}.\x27’-]+)+\s*$' AND pmod(size(split(s, ',')), 2) = 0
          THEN transform(sequence(0, size(split(s, ',')) div 2 - 1), i -> concat(split(s, ',')[2 * i], ',', split(s, ',')[2 * i + 1]))
        ELSE split(s, ',') END))""",
}

#: What is dropped around a value, and values that are none.
MARKS = {
    "tags": r"^[\s\[\]]+|[\s\[\]]+$",
    "addresses": r"^(?:[\s*†‡§¹²³⁴⁵⁶⁷⁸⁹⁰\[\]]|\(\d+\)|\d{1,2}[.)]\s|\d{1,2}\s+(?=\p{Lu})|[a-z]\s+(?=\p{Lu}))+|[\s\[\],]+$",
    "names": r"^(?:[\s\[\]*,]|\(\d+\)|\d{1,2}[.)]\s)+|[\s\[\],]+$|[\s,]+(?:et\s+al\.?|等人?)\s*$",
}
NO_VALUE = r"^(?:et\s+al\.?|等人?)$"


def unpack(cells: DataFrame, kind: str) -> DataFrame:
    """(id, pos, value, n) for ``cells(id, cell)``; n is the number of values in the cell."""
    return sql(
        cells.sparkSession,
        r"""
        SELECT id, CAST(place + 1 AS INT) AS pos, value, n FROM (
          SELECT id, size(found) AS n, posexplode(found) AS (place, value) FROM (
            SELECT id, filter(transform(folded, v -> regexp_replace(regexp_replace(v, {marks}, ''), {marks}, '')), v -> v <> '' AND NOT v RLIKE {none}) AS found FROM (
              SELECT id, aggregate(parts, array(''), (held, more) ->
                concat(slice(held, 1, size(held) - 1), array(concat(element_at(held, -1), more[0])), slice(more, 2, greatest(size(more) - 1, 0)))) AS folded FROM (
                SELECT id, transform(transform(pieces, (p, i) -> IF(pmod(i, 2) = 1 AND i = size(pieces) - 1, concat(quote, p), p)), (piece, i) -> IF(pmod(i, 2) = 1 AND i < size(pieces) - 1, array(piece), {parts})) AS parts FROM (
                  SELECT id, IF(cell RLIKE r'^\s*\[\s*\x27', chr(39), '"') AS quote, IF(cell RLIKE r'^\s*\[\s*\x27', split(cell, r'\x27'), split(translate(cell, '“”＂', repeat('"', 3)), '"')) AS pieces
                  FROM (SELECT DISTINCT id, cell FROM {cells} WHERE cell IS NOT NULL AND lower(trim(cell)) NOT IN ({unknown})))))))""",
        cells=cells,
        parts=PARTS[kind],
        marks=f"r'{MARKS[kind]}'",
        none=f"r'{NO_VALUE}'",
        unknown=", ".join(f"'{x}'" for x in UNKNOWN),
    )


#: Fields, their table and their kind.
FIELDS = {
    "first_author_affiliation_raw": ("affiliations", "card_id", "addresses"),
    "Tags": ("summary", "人工参阅编号", "tags"),
    "作者": ("summary", "人工参阅编号", "names"),
}


def packed_values(affiliations: DataFrame, summary: DataFrame) -> DataFrame:
    """(field, card_id, pos, value, n) of every packed field."""
    tables = {"affiliations": affiliations, "summary": summary}
    parts = []
    for field, (table, key, kind) in FIELDS.items():
        values = unpack(tables[table].selectExpr(f"`{key}` AS id", f"`{field}` AS cell"), kind)
        parts.append(values.selectExpr(f"'{field}' AS field", "id AS card_id", "pos", "value", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
