"""Documents put into containers of fixed capacity by Karmarkar-Karp multiway differencing.

Token counts come from a public tokenizer whose file is a parameter. A document longer than a container
is cut into full containers and one rest; everything else stays whole. Documents are spread by hash over
shards of bounded size, and every shard is partitioned on its own: each item starts as a partial
partition, and the two partial partitions of the largest spread are merged with opposing imbalances
(largest sum onto smallest) until one is left, which gives near-equal windows. Where a window is over
capacity, items are exchanged between the fullest and the emptiest windows; if that doesn't help, the
number of windows rises by one.

Defined results: null and empty texts have no tokens and go into the first container of their shard;
repeated ids are separate documents; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marginalia.session import cut_lineage

CAPACITY = 2048
#: A sentencepiece model of the public tokenizers.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Tokens in a shard, and documents, about.
SHARD = 1 << 20
SHARD_DOCUMENTS = 1 << 16


@functools.cache
def _tokenizer(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _counter(path: str) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _tokenizer(path)
        for frame in frames:
            texts = frame.text.fillna("").tolist()
            sizes = []
            for at in range(0, len(texts), 256):
                sizes += [len(ids) for ids in model.encode(texts[at : at + 256], num_threads=1)]
            yield pd.DataFrame({"doc_id": frame.doc_id, "n_tokens": np.array(sizes, np.int64)})

    return run


def differencing(sizes: np.ndarray, m: int) -> np.ndarray:
    """The window (0 to m - 1) of every item, by largest-differencing of m-way partial partitions."""
    n = len(sizes)
    if m == 1 or n == 0:
        return np.zeros(n, np.int64)
    # a node is a set of items: nodes 1..n are single items, later ones join two nodes; 0 is empty
    left, right = [], []
    heap = []
    for k, size in enumerate(sizes.tolist()):
        heap.append((-size, k, np.array([size], np.int64), np.array([k + 1])))
    heapq.heapify(heap)
    serial, node = n, n + 1
    while len(heap) > 1:
        _, _, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        # sums are kept in falling order without trailing zeros; opposing order joins a's largest with b's smallest
        both = len(a) + len(b) - m
        if both <= 0:
            sums, ids = np.concatenate([a, b]), np.concatenate([ia, ib])
        else:
            sums = np.concatenate([a[: len(a) - both], b[: len(b) - both], a[len(a) - both :] + b[len(b) - both :][::-1]])
            joined = np.arange(node, node + both)
            left += ia[len(a) - both :].tolist()
            right += ib[len(b) - both :][::-1].tolist()
            node += both
            ids = np.concatenate([ia[: len(a) - both], ib[: len(b) - both], joined])
        order = np.argsort(-sums, kind="stable")
        sums, ids = sums[order], ids[order]
        spread = int(sums[0] - (sums[-1] if len(sums) == m else 0))
        heapq.heappush(heap, (-spread, serial, sums, ids))
        serial += 1
    window = np.zeros(n, np.int64)
    for w, top in enumerate(heap[0][3].tolist()):
        stack = [top]
        while stack:
            x = stack.pop()
            if x <= n:
                window[x - 1] = w
            else:
                stack += (left[x - n - 1], right[x - n - 1])
    return window


def repair(sizes: np.ndarray, window: np.ndarray, m: int, capacity: int) -> bool:
    """Exchange items between windows over capacity and windows with room, in place; True if all fit."""
    sums = np.bincount(window, sizes, m).astype(np.int64)
    members = [np.flatnonzero(window == w).tolist() for w in range(m)]
    for _ in range(8 * m):
        over = int(np.argmax(sums))
        excess = int(sums[over] - capacity)
        if excess <= 0:
            return True
        best = None
        for other in np.argsort(sums)[:16].tolist():
            room = int(capacity - sums[other])
            if room <= 0:
                continue
            a, b = np.array([0, *(sizes[k] for k in members[over])]), np.array([0, *(sizes[k] for k in members[other])])
            moved = a[:, None] - b[None, :]  # what leaves the full window
            ok = (moved > 0) & (moved <= room)
            if not ok.any():
                continue
            # the move that leaves least excess, then least loss of room
            score = np.where(ok, np.maximum(excess - moved, 0) * 4 + np.maximum(moved - excess, 0), 1 << 40)
            at = np.unravel_index(np.argmin(score), score.shape)
            if best is None or score[at] < best[0]:
                best = (int(score[at]), other, int(at[0]), int(at[1]), int(moved[at]))
            if best[0] == 0:
                break
        if best is None:
            return False
        _, other, i, j, moved = best
        mine = members[over].pop(i - 1) if i else None
        theirs = members[other].pop(j - 1) if j else None
        if mine is not None:
            members[other].append(mine)
            window[mine] = other
        if theirs is not None:
            members[over].append(theirs)
            window[theirs] = over
        sums[over] -= moved
        sums[other] += moved
    return False


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows of at most ``capacity`` for items of at most that size, and their number."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, m)
        if repair(sizes, window, m, capacity):
            return window, m
        m += 1


def _pack(capacity: int) -> Callable:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
        doc, shard, tokens = frame.doc_id.to_numpy(), int(frame.shard.iloc[0]), frame.n_tokens.to_numpy(np.int64)
        rest = np.where(tokens > capacity, tokens % capacity, tokens)
        full = (tokens - rest) // capacity
        window, m = windows(rest, capacity)
        owner = np.repeat(np.arange(len(doc)), full)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        keep = (rest > 0) | (full == 0)
        index = np.concatenate([m + np.arange(len(owner)), window[keep]])
        return pd.DataFrame(
            {
                "doc_id": np.concatenate([doc[owner], doc[keep]]),
                "piece": np.concatenate([piece, full[keep]]).astype(np.int32),
                "token_start": np.concatenate([piece * capacity, (full * capacity)[keep]]),
                "n_tokens": np.concatenate([np.full(len(owner), capacity), rest[keep]]).astype(np.int64),
                "container": [f"{shard}-{k}" for k in index],
            }
        )

    return run


def token_counts(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens) of whole texts."""
    return documents.select("doc_id", "text").mapInPandas(_counter(model), "doc_id long, n_tokens long")


def pack(documents: DataFrame, capacity: int = CAPACITY, model: str = MODEL, shard_tokens: int = SHARD) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, container) of every document or piece of one."""
    counts = cut_lineage(token_counts(documents, model))
    total, n = counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    shards = max(1, round(total / shard_tokens), -(-n // SHARD_DOCUMENTS))
    placed = counts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    # a number of partitions that is asked for isn't coalesced: shards are small, but each takes a while
    spread = placed.repartition(min(shards, max(64, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "shard")
    return spread.groupBy("shard").applyInPandas(_pack(capacity), "doc_id long, piece int, token_start long, n_tokens long, container string")
