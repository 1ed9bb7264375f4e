"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.plans import cards, changes, items, library, packets, reports, round_trips, tags, texts

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (library, items, tags, changes, cards, texts, packets, reports, round_trips)

QUERIES: dict[str, Query] = {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def _bigint_counts(text: str) -> str:
    """count_if gives DuckDB's widest integer, which clients show as a float; here it is a BIGINT like count."""
    out, at = "", 0
    while (begin := text.find("count_if(", at)) >= 0:
        end, depth = begin + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out += f"{text[at:begin]}CAST({text[begin:end]} AS BIGINT)"
        at = end
    return out + text[at:]


ORACLES: dict[str, str] = {name: _bigint_counts(text) for module in _MODULES for name, text in module.ORACLES.items()}
