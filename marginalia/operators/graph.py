"""Connected components of an undirected graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marginalia.functions.sql import sql
from marginalia.session import cut_lineage


def _mark(links: DataFrame) -> tuple:
    """Number and two independent 64-bit sums of the distinct rows: equal marks are equal tables, but for a chance of 2^-128."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for ``edges(a, b)``; root is the least node of the component.

    Alternating large-star and small-star steps: every step links nodes to the least neighbour, so a
    hub is an aggregate of its neighbours and never a list of them. Loops and repeats don't matter.
    """
    spark = edges.sparkSession
    links = cut_lineage(sql(spark, "SELECT DISTINCT greatest(a, b) AS u, least(a, b) AS v FROM {edges} WHERE a <> b", edges=edges))
    state = _mark(links)
    for _ in range(200):
        large = sql(
            spark,
            """
            WITH both AS (SELECT u AS x, v AS y FROM {links} UNION ALL SELECT v, u FROM {links}),
            least_of AS (SELECT x, least(x, min(y)) AS m FROM both GROUP BY x)
            SELECT DISTINCT b.y AS u, m.m AS v FROM both b JOIN least_of m ON b.x = m.x WHERE b.y > b.x AND b.y <> m.m""",
            links=links,
        )
        small = sql(
            spark,
            """
            WITH least_of AS (SELECT u, min(v) AS m FROM {links} GROUP BY u)
            SELECT DISTINCT x AS u, m AS v FROM (
              SELECT l.v AS x, m.m FROM {links} l JOIN least_of m ON l.u = m.u UNION ALL SELECT u, m FROM least_of) WHERE x <> m""",
            links=large,
        )
        links, last = cut_lineage(small), state
        state = _mark(links)
        if state == last:
            return sql(spark, "SELECT u AS node, v AS root FROM {links} UNION SELECT v, v FROM {links}", links=links)
    raise RuntimeError("the components did not settle")
