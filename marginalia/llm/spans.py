"""Long spans that records share verbatim, found from difference-cover anchors.

A difference cover D modulo v holds, for every distance d, two members that differ by d. So two
records with a common stretch of ``length`` characters, wherever it lies in each, have within its
first v positions one that is in D modulo v in both. Windows of length - v + 1 characters are
therefore hashed only at cover positions, and every long match shares at least one such anchor.

A shared anchor is then extended: the windows of full length around it are hashed at every position
with two independent 64-bit hashes, and a position is shared if the same window occurs in another
record. Counting per hash instead of comparing pairs keeps the work linear in the text, however many
records hold a passage. Hashes are made and shuffled once. What a batch of records shares within itself is
settled in the batch: one row of it goes to the hash's group, the others are spread over all tasks, so a
passage that a third of all records hold makes no group larger than the number of batches. Records with
equal texts are one class: they are shared as a whole, and one of them stands for the class.

Defined results: null texts and texts shorter than ``length`` share nothing; an empty table gives no
rows; repeated ids keep their own rows only if their texts differ; further columns are ignored; texts
are processed whole, whatever their length; positions count code points.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.functions.sql import sql
from marginalia.llm.rolling import codes, window_hashes
from marginalia.session import cut_lineage

#: Characters hashed at a time in a Python worker; longer texts go through alone.
CHUNK = 1_000_000


@functools.cache
def difference_cover(q: int = 11) -> tuple[int, list[int]]:
    """A period v = q^2 + q + 1 and q + 1 positions of which two differ by d, for every d modulo v; q is a prime.

    Singer's rule: the powers of a root of a cubic over the field of q elements run through the points of
    a projective plane; the exponents of the points on one line are the positions.
    """
    period = q * q + q + 1
    for a, b, c in itertools.product(range(q), range(q), range(1, q)):
        point, line, seen = (1, 0, 0), [], set()
        for k in range(period):
            scale = pow(next(x for x in reversed(point) if x), -1, q)
            seen.add(tuple(x * scale % q for x in point))
            if point[2] == 0:
                line.append(k)
            x, y, z = point
            point = (z * c % q, (x + z * b) % q, (y + z * a) % q)
        if len(seen) == period and len({(i - j) % period for i in line for j in line}) == period:
            return period, line
    raise ValueError("q must be a prime")


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _settled(hashes: np.ndarray, docs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(sure, lone) by row: is the hash shared within these rows (by two documents, where they count), and is the row the one that goes to its group?"""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.empty(len(ranked), bool)
    if len(ranked):
        first[0] = True
        np.not_equal(ranked[1:], ranked[:-1], out=first[1:])
    begins = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    if docs is None:
        shared = np.diff(np.append(begins, len(ranked))) > 1
    else:
        own = docs[order]
        shared = np.minimum.reduceat(own, begins) != np.maximum.reduceat(own, begins) if len(begins) else np.zeros(0, bool)
    sure, lone = np.empty(len(ranked), bool), np.empty(len(ranked), bool)
    sure[order] = shared[group]
    # where a hash isn't shared within the rows, every one of them goes to the group
    lone[order] = first | ~shared[group]
    return sure, lone


def _routed(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray, checks: np.ndarray | None = None) -> pa.RecordBatch:
    """(key, doc, place) by row, with second hashes also check: the hash is the key of rows that go to its group.

    A settled row has its document and place for a key, which any other row hardly has, no check, and a place
    below zero, -1 - place. Keys come from the row alone, so a task that is run again sends its rows the same way.
    """
    # within a batch both hashes must agree: their mixture stands for the pair
    sure, lone = _settled(hashes, None) if checks is None else _settled(hashes ^ (checks * np.int64(-0x61C8864680B583EB)), docs)
    own = (docs.astype(np.int64) << np.int64(24)) ^ places
    columns = {"key": np.where(lone, hashes, own), "doc": docs, "place": np.where(sure, -1 - places, places).astype(np.int32)}
    if checks is not None:
        columns["check"] = np.where(lone, checks, 0)
    return pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in columns.items()})


def _anchors(length: int, q: int) -> Callable:
    period, cover = difference_cover(q)
    width = length - period + 1
    is_cover = np.zeros(period, bool)
    is_cover[cover] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
            for a, b in _chunks(texts):
                sizes = np.array([len(t) for t in texts[a:b]])
                begins = np.concatenate([[0], np.cumsum(sizes)])
                place = np.arange(begins[-1]) - np.repeat(begins[:-1], sizes)
                wanted = is_cover[place % period] & (place + width <= np.repeat(sizes, sizes))
                starts = np.flatnonzero(wanted)
                hashes = window_hashes(codes("".join(texts[a:b])), starts, width)
                yield _routed(hashes, np.repeat(ids[a:b], sizes)[starts], place[starts])

    return run


def _windows(length: int, q: int) -> Callable:
    period, _ = difference_cover(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, places = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("text").to_pylist(), batch.column("places").to_pylist()
            for a, b in _chunks(texts):
                sizes = np.array([len(t) for t in texts[a:b]])
                begins = np.concatenate([[0], np.cumsum(sizes)])
                edges = np.zeros(begins[-1] + 1, np.int32)  # +1 where a run of candidate starts begins, -1 behind it
                for k, at in enumerate(places[a:b]):
                    at = np.asarray(at)
                    first = np.maximum(at - (period - 1), 0)
                    last = np.minimum(at, sizes[k] - length)
                    ok = first <= last
                    np.add.at(edges, begins[k] + first[ok], 1)
                    np.add.at(edges, begins[k] + last[ok] + 1, -1)
                starts = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
                spread = codes("".join(texts[a:b]))
                owner = np.repeat(np.arange(b - a), sizes)[starts]
                docs = ids[a:b][owner]
                hashes, checks = window_hashes(spread, starts, length, 0), window_hashes(spread, starts, length, 1)
                # within a batch both hashes must agree: their mixture stands for the pair
                yield _routed(hashes, docs, starts - begins[:-1][owner], checks)

    return run


def shared_spans(documents: DataFrame, length: int = 240, q: int = 11) -> DataFrame:
    """(doc_id, span_start, span_end): the maximal runs of shared characters of ``documents(doc_id, text)``."""
    spark = documents.sparkSession
    texts = documents.selectExpr("doc_id AS doc", "text").where(F.length("text") >= length).withColumn("digest", F.unhex(F.md5("text")))
    members = cut_lineage(texts.select("doc", "digest", F.length("text").alias("size")).distinct())
    groups = cut_lineage(members.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    copies = cut_lineage(sql(spark, "SELECT doc, digest FROM {members} JOIN {groups} USING (digest) WHERE doc <> rep", members=members, groups=groups))
    kept = texts.join(copies, ["doc", "digest"], "left_anti").select("doc", "text")
    anchors = kept.mapInArrow(_anchors(length, q), "key long, doc long, place int")
    # one shuffle: a row that is settled already goes anywhere, by a key of its own
    places = sql(
        spark,
        """
        SELECT doc, collect_list(IF(place < 0, -1 - place, place)) AS places FROM (SELECT doc, place, count(*) OVER (PARTITION BY key) AS n FROM {anchors})
        WHERE place < 0 OR n > 1 GROUP BY doc""",
        anchors=anchors,
    )
    # a document with an equal one is shared as a whole, but its windows still count for others
    windows = kept.join(cut_lineage(places).hint("shuffle_hash"), "doc").mapInArrow(_windows(length, q), "key long, doc long, place int, check long")
    return sql(
        spark,
        """
        WITH counted AS (
          SELECT doc, IF(place < 0, -1 - place, place) AS place, min(place) OVER w < 0 AS settled, min(doc) OVER w AS low, max(doc) OVER w AS high FROM {windows}
          WINDOW w AS (PARTITION BY key, check)),
        runs AS (
          SELECT doc, place, sum(opens) OVER (PARTITION BY doc ORDER BY place) AS run FROM (
            SELECT doc, place, IF(place <= lag(place) OVER (PARTITION BY doc ORDER BY place) + {length}, 0, 1) AS opens FROM counted WHERE settled OR low <> high))
        SELECT doc AS doc_id, min(place) AS span_start, max(place) + {length} AS span_end
        FROM runs LEFT ANTI JOIN {groups} ON doc = rep GROUP BY doc, run
        UNION ALL
        SELECT DISTINCT doc, 0, size FROM {members} JOIN {groups} USING (digest)""",
        windows=windows,
        groups=groups,
        members=members,
        length=length,
    )


def shared_share(documents: DataFrame, length: int = 240, q: int = 11) -> DataFrame:
    """(doc_id, n_chars, n_shared, share) for every document: how much of it is found elsewhere."""
    spans = shared_spans(documents, length, q).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    sizes = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    joined = sizes.join(spans, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))
    return joined.withColumn("share", F.when(F.col("n_chars") > 0, F.col("n_shared") / F.col("n_chars")).otherwise(0.0))
