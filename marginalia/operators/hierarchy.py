"""Parent-child rows to full hierarchies.

1. Cycles are exposed by peeling leaves off until nothing but cycles is left. Chains are shortened at
   the same time (a node with one child may be spliced out, chosen by hashed coins so that no two
   neighbours go at once), so the rounds grow with the logarithm of the depth. One node of each cycle
   remains; its link is cut and its whole tree is marked.
2. The forest becomes Euler tours: every node has an arc down to it and an arc up from it. Parallel
   list ranking (pointer jumping) gives each arc its distance to the end of its tour, the balance of
   the arcs behind it, and the tour's root.
3. Entry and exit distances nest: they give depth, number of descendants, and, by one scan with a
   stack over bounded blocks of a tour, ancestors and paths.

Sibling order is by hashed bucket, then key, so a parent that holds a third of all rows is spread over
buckets of about ``SIBLINGS`` nodes instead of one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from marginalia.functions.sql import sql
from marginalia.functions.text import trim_ws
from marginalia.session import cut_lineage

CYCLE = "cycle"


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node): one node of every cycle among ``edges(node, parent)``; each node has one parent at most."""
    spark = edges.sparkSession
    left = edges
    for turn in range(10_000):
        marked = cut_lineage(
            sql(
                spark,
                """
                SELECT node, parent, n IS NULL AS leaf,
                       coalesce(n = 1 AND only <> node AND pmod(xxhash64(node, {turn}), 2) = 1 AND pmod(xxhash64(only, {turn}), 2) = 0, FALSE) AS spliced
                FROM {left} e LEFT JOIN (SELECT parent AS p, count(*) AS n, min(node) AS only FROM {left} GROUP BY parent) k ON e.node = k.p""",
                left=left,
                turn=turn,
            )
        )
        if marked.where("node <> parent").isEmpty():
            return marked.select("node")
        left = sql(
            spark,
            """
            SELECT e.node, coalesce(s.parent, e.parent) AS parent
            FROM {marked} e LEFT JOIN (SELECT node, parent FROM {marked} WHERE spliced AND NOT leaf) s ON e.parent = s.node
            WHERE NOT e.leaf AND NOT e.spliced""",
            marked=marked,
        )
    raise RuntimeError("the links did not shrink")


def euler_arcs(forest: DataFrame, buckets: int = 32) -> DataFrame:
    """(arc, next, pos, balance, tail): the arcs of ``forest(node, parent)``; 'key>' leads down to a node, 'key<' up from it."""
    spark = forest.sparkSession
    kids = forest.where("parent IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)))
    kids = kids.withColumn("beside", F.lead("node").over(Window.partitionBy("parent", "bucket").orderBy("node")))
    firsts = kids.groupBy("parent", "bucket").agg(F.min("node").alias("first"))
    firsts = firsts.withColumn("beside", F.lead("first").over(Window.partitionBy("parent").orderBy("bucket")))
    return sql(
        spark,
        """
        WITH linked AS (
          SELECT f.node, f.parent, c.first, coalesce(k.beside, b.beside) AS beside
          FROM {forest} f
          LEFT JOIN {kids} k ON f.node = k.node
          LEFT JOIN {firsts} b ON k.parent = b.parent AND k.bucket = b.bucket
          LEFT JOIN (SELECT parent, min_by(first, bucket) AS first FROM {firsts} GROUP BY parent) c ON f.node = c.parent)
        SELECT arc, next, 1L AS pos, balance, arc AS tail FROM (
          SELECT inline(array(
            struct(node || '>' AS arc, coalesce(first || '>', node || '<') AS next, 1L AS balance),
            struct(node || '<' AS arc, coalesce(beside || '>', parent || '<') AS next, -1L AS balance)))
          FROM linked)""",
        forest=forest,
        kids=kids,
        firsts=firsts,
    )


def rank_list(arcs: DataFrame) -> DataFrame:
    """Pointer jumping: pos and balance summed from each arc to the end of its list, tail its last arc.

    A round follows three pointers, so the reach of an arc grows fourfold. Arcs that have reached the end
    only serve as targets; an arc that reaches it within a round looks for no further target (its stand-in
    key fits none, and differs from arc to arc, so that no partition gathers them).
    """
    state = cut_lineage(arcs)
    for _ in range(32):
        if state.where("next IS NOT NULL").isEmpty():
            return state
        state = cut_lineage(
            sql(
                state.sparkSession,
                """
                SELECT arc, next, pos, balance, tail FROM {state} WHERE next IS NULL
                UNION ALL
                SELECT a.arc, coalesce(d.next, IF(d.arc IS NULL, coalesce(c.next, IF(c.arc IS NULL, b.next, NULL)), NULL)) AS next,
                       a.pos + b.pos + coalesce(c.pos, 0L) + coalesce(d.pos, 0L) AS pos, a.balance + b.balance + coalesce(c.balance, 0L) + coalesce(d.balance, 0L) AS balance,
                       coalesce(d.tail, c.tail, b.tail) AS tail
                FROM {state} a
                JOIN {state} b ON a.next = b.arc
                LEFT JOIN {state} c ON coalesce(b.next, a.arc || '!') = c.arc
                LEFT JOIN {state} d ON coalesce(c.next, a.arc || '!') = d.arc
                WHERE a.next IS NOT NULL""",
                state=state,
            )
        )
    raise RuntimeError("a list has no end")


def _scan(keep: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One pass over blocks of tours with the stack of open nodes: paths, and ancestors if they are kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, stack = None, []
        for frame in frames:
            rows = []
            for top, part, own, node, name, entry, leave in zip(frame.top, frame.part, frame.own, frame.node, frame.name, frame.entry, frame.leave):
                if (top, part) != block:
                    block, stack = (top, part), []
                while stack and stack[-1][1] > entry:
                    stack.pop()
                path = f"{stack[-1][2]}/{name}" if stack else name
                if own:
                    rows.append((node, [x[0] for x in stack] if keep else None, path))
                stack.append((node, leave, path))
            if rows:
                yield pd.DataFrame(rows, columns=["node", "ancestors", "path"])

    return run


#: Nodes of a bucket of siblings, about.
SIBLINGS = 50_000


def toured(links: DataFrame, block: int = 4096, ancestors: bool = True, cyclic: bool = False) -> tuple[DataFrame, DataFrame]:
    """The tours of ``links(node, parent, name)`` and what one scan over them gives.

    The first table is (node, name, top, cyclic, depth, entry, leave, closes): top is the root of the tree,
    or the node at which a cycle was cut, and closes is the parent that node had. The second is (node,
    ancestors, path), below the top of its tree; nodes of cyclic trees are left out unless ``cyclic``.
    """
    spark = links.sparkSession
    links = cut_lineage(links.select("node", "parent", "name"))
    cut = cut_lineage(sql(spark, "SELECT c.node, l.parent AS closes FROM {cut} c JOIN {links} l ON c.node = l.node", cut=cycle_nodes(links.select("node", "parent").where("parent IS NOT NULL")), links=links))
    forest = sql(
        spark,
        "SELECT l.node, IF(c.node IS NULL, l.parent, NULL) AS parent FROM {links} l LEFT JOIN {cut} c ON l.node = c.node",
        links=links,
        cut=cut,
    )
    ranked = rank_list(euler_arcs(forest, max(32, links.count() // SIBLINGS)))
    spans = cut_lineage(
        sql(
            spark,
            """
            SELECT r.node, l.name, r.top, c.node IS NOT NULL AS cyclic, c.closes, r.depth, r.entry, r.leave
            FROM (SELECT left(arc, length(arc) - 1) AS node, min(left(tail, length(tail) - 1)) AS top, max(pos) AS entry, min(pos) AS leave,
                         -max_by(balance, pos) AS depth
                  FROM {ranked} GROUP BY left(arc, length(arc) - 1)) r
            JOIN {links} l ON r.node = l.node
            LEFT JOIN {cut} c ON r.top = c.node""",
            ranked=ranked,
            links=links,
            cut=cut,
        )
    )
    # distances count down along a tour; a node stands open at the start of every block that its span runs across
    placed = sql(
        spark,
        """
        SELECT top, entry div {block} AS part, TRUE AS own, node, name, entry, leave FROM {spans} WHERE {wanted}
        UNION ALL
        SELECT top, explode(sequence(leave div {block}, entry div {block} - 1)), FALSE, node, name, entry, leave
        FROM {spans} WHERE {wanted} AND entry div {block} > leave div {block}""",
        spans=spans,
        block=block,
        wanted="TRUE" if cyclic else "NOT cyclic",
    )
    scanned = placed.repartition("top", "part").sortWithinPartitions("top", "part", F.desc("entry")).mapInPandas(_scan(ancestors), "node string, ancestors array<string>, path string")
    return spans, scanned


def hierarchy(links: DataFrame, block: int = 4096, ancestors: bool = True) -> DataFrame:
    """(node, root, depth, path, ancestors, n_descendants, cyclic) for ``links(node, parent, name)``.

    One row per node, parents resolved (null: a root). Nodes that never reach a root have cyclic = true,
    root ``cycle``, depth -1, an empty path, no ancestors and -1 descendants. Where ancestors aren't asked
    for, their lists are neither built nor kept.
    """
    spans, scanned = toured(links, block, ancestors)
    return sql(
        links.sparkSession,
        """
        SELECT s.node, IF(cyclic, '{mark}', top) AS root, CAST(IF(cyclic, -1, depth) AS INT) AS depth, coalesce(p.path, '') AS path,
               coalesce(p.ancestors, CAST(array() AS ARRAY<STRING>)) AS ancestors, CAST(IF(cyclic, -1, (entry - leave - 1) div 2) AS INT) AS n_descendants, cyclic
        FROM {spans} s LEFT JOIN {scanned} p ON s.node = p.node""",
        spans=spans,
        scanned=scanned,
        mark=CYCLE,
    )


def latest_links(collections: DataFrame) -> DataFrame:
    """(node, parent, name): the latest state of every key, with parents that aren't keys dropped.

    Blanks around keys don't count; rows without a key are left out; of rows with the same time the
    greatest by name and parent counts; the key stands in for a missing or blank name.
    """
    rows = collections.select(
        trim_ws("collection_key").alias("node"),
        F.struct(
            F.col("last_seen_at"),
            F.col("name"),
            trim_ws("parent_key").alias("parent"),
        ).alias("state"),
    ).where("node <> ''")
    latest = rows.groupBy("node").agg(F.max("state").alias("state")).select("node", "state.*")
    return sql(
        collections.sparkSession,
        """
        SELECT l.node, p.node AS parent, IF(trim(coalesce(l.name, '')) = '', l.node, l.name) AS name
        FROM {latest} l LEFT JOIN (SELECT node FROM {latest}) p ON l.parent = p.node AND NOT l.parent IN ('', 'false')""",
        latest=latest,
    )


def collection_hierarchy(collections: DataFrame, ancestors: bool = True) -> DataFrame:
    """The hierarchy of the collections table; an empty table gives no rows, further columns are ignored."""
    return hierarchy(latest_links(collections), ancestors=ancestors)
