"""Slash-separated paths: prefixes, scopes and walks up a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions.sql import sql
from marginalia.operators.hierarchy import toured
from marginalia.session import cut_lineage


def prefixes(x: Column) -> Column:
    """Every prefix of a path, from its first part to all of it."""
    parts = F.split(x, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def under(path: Column, root: Column) -> Column:
    """A path that is the root or lies below it."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def missing_prefixes(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(path, depth): prefixes of wanted paths that aren't held, in the order they must be made."""
    every = wanted.select(F.explode(prefixes(F.col("path"))).alias("path")).distinct()
    lacking = every.join(held.select("path").distinct(), "path", "left_anti")
    return lacking.select("path", (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))).alias("depth"))


def walk_up(links: DataFrame) -> DataFrame:
    """(node, path): names from the top down for ``links(node, parent, name)``.

    A parent that isn't a node gives its key as the topmost part; a cycle is broken at the first node
    that comes again, as if every node walked up on its own.

    Paths come from the tours of the forest, so rounds grow with the logarithm of the depth. Missing
    parents take part as roots named by their key. A cycle is cut at one node; below it a path holds the
    cycle's nodes k0 to ki and goes on, and walking up from ki would go round, over the rest of the cycle.
    """
    spark = links.sparkSession
    whole = sql(
        spark,
        """
        SELECT node, parent, name FROM {links}
        UNION ALL
        SELECT DISTINCT parent, CAST(NULL AS STRING), parent FROM {links} l LEFT ANTI JOIN (SELECT node AS held FROM {links}) h ON l.parent = h.held WHERE parent IS NOT NULL""",
        links=links,
    )
    spans, scanned = toured(whole, cyclic=True)
    paths = cut_lineage(sql(spark, "SELECT s.node, s.name, s.top, s.cyclic, s.closes, p.ancestors, p.path FROM {spans} s JOIN {scanned} p ON s.node = p.node", spans=spans, scanned=scanned))
    rings = sql(
        spark,
        """
        SELECT r.top, array_sort(collect_list(struct(r.place, r.at, n.name))) AS ring
        FROM (SELECT top, posexplode(array_append(ancestors, node)) AS (place, at) FROM {paths} WHERE cyclic AND node = closes) r JOIN {paths} n ON r.at = n.node
        GROUP BY r.top""",
        paths=paths,
    )
    return sql(
        spark,
        """
        SELECT l.node, coalesce(concat(array_join(transform(slice(ring, 1 + size(array_intersect(array_append(ancestors, l.node), transform(ring, x -> x.at))), size(ring)), x -> x.name), '/'),
                                       IF(size(array_intersect(array_append(ancestors, l.node), transform(ring, x -> x.at))) < size(ring), '/', ''), path), path) AS path
        FROM (SELECT node FROM {links}) l JOIN {paths} p ON l.node = p.node LEFT JOIN {rings} r ON p.cyclic AND p.top = r.top""",
        links=links,
        paths=paths,
        rings=rings,
    )
