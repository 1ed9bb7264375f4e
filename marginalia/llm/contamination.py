"""Evaluation texts found inside corpus documents.

Texts become sequences of units: words, or characters where a test item is mostly Han script. Case,
punctuation, spacing and compatibility forms don't count. Every window of item size (12 words, 24
characters) of every item, and every window of that size give or take ``max_edits`` units of every
document, is embedded by the CGK random walk, which reads the window through a pointer that random bits
of the unit under it move or hold, so that a small edit distance becomes a small Hamming distance.
Bit-sampling LSH keys of the embedding, repeated with fresh randomness until the target recall is reached
for the hardest kind of edit, are joined by equality, and every pair is verified by its exact edit
distance. With ``max_edits = 0`` equal windows have equal embeddings and one repetition has recall 1.

The corpus is scanned once, whatever the number of items. Its windows pass a Bloom filter of the items'
keys before anything is shuffled; the filter has a fixed greatest size (``FILTER_BITS``), beyond which
more windows pass it and none is lost. Neither documents, items nor keys are gathered on the driver.

The instruction sentence that opens several items is left out of each of them. Defined results: null
and short texts hold nothing; empty tables give no rows; repeated rows of either table count once;
further columns are ignored; texts are processed whole.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.functions.sql import sql
from marginalia.llm.rolling import POWERS, mix
from marginalia.session import cut_lineage

#: Units of a window, by mode.
WORDS, CHARS = 12, 24
#: Characters worked on at a time.
CHUNK = 500_000
#: Bits of the filter of item keys: sixteen for each key, this many at most (32 MB).
FILTER_BITS = 1 << 28
#: Places of the embedding that a key samples: many where equal windows are wanted, fewer where edits must be missed.
SAMPLES, SAMPLES_WITH_EDITS = 16, 8


@functools.cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter or digit; is it Han."""
    text = [chr(c) for c in range(0x110000)]
    letters = np.fromiter((c.isalnum() for c in text), bool, len(text))
    han = np.zeros(len(text), bool)
    for low, high in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)):
        han[low : high + 1] = True
    return letters, han


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(unicodedata.normalize("NFKC", text).casefold().encode("utf-32-le", "surrogatepass"), np.uint32)


def mostly_han(points: np.ndarray) -> bool:
    letters, han = _kinds()
    return 2 * han[points].sum() > letters[points].sum()


def word_units(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits) and the places where they begin."""
    letters, _ = _kinds()
    edges = np.diff(letters[points].astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = POWERS[0].upto(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points) * down[: len(points)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * up[begin]), begin


def char_units(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    letters, _ = _kinds()
    at = np.flatnonzero(letters[points])
    return mix(points[at]), at


def cgk_keys(units: np.ndarray, starts: np.ndarray, n: int, sizes: list[int], turn: int, samples: int) -> list[np.ndarray]:
    """For each size, LSH keys of the windows units[s : s + size]: ``samples`` places of their CGK embedding of length 3 n.

    Beyond its end a window reads zeros. The walk itself is the same for all sizes, so it is done once.
    """
    rng = np.random.default_rng([n, turn])
    chosen = set(rng.choice(3 * n, min(samples, 3 * n), replace=False).tolist())
    seeds = rng.integers(0, 1 << 63, 1 + 3 * n // 64, dtype=np.uint64)
    bits = [mix(units ^ seed) for seed in seeds]
    at = starts.astype(np.int64)
    keys = [np.zeros(len(starts), np.uint64) for _ in sizes]
    ends = [starts + size for size in sizes]
    last = len(units) - 1
    for step in range(max(chosen) + 1):
        here = np.minimum(at, last)
        if step in chosen:
            unit = units[here]
            for k, end in enumerate(ends):
                key = (keys[k] ^ np.where(at < end, unit, np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
                keys[k] = key ^ (key >> np.uint64(29))
        at = at + ((bits[step // 64][here] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64)
    return keys


def within_edits(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which rows of ``a`` and ``b`` are within ``most`` edits of each other: exact, in a band of that width, all rows at once."""
    n, m = a.shape[1], b.shape[1]
    if abs(n - m) > most:
        return np.zeros(len(a), bool)
    far = np.full(len(a), most + 1, np.int64)
    row = {j: np.full(len(a), j, np.int64) for j in range(min(m, most) + 1)}
    for i in range(1, n + 1):
        new: dict[int, np.ndarray] = {}
        for j in range(max(0, i - most), min(m, i + most) + 1):
            best = row.get(j, far) + 1
            if j:
                best = np.minimum(best, row.get(j - 1, far) + (a[:, i - 1] != b[:, j - 1]))
                best = np.minimum(best, new.get(j - 1, far) + 1)
            new[j] = np.minimum(best, most + 1)
        row = new
    return row[m] <= most


def with_edit(window: list[int], place: int, kind: str, fresh: int) -> list[int]:
    """A window with one unit at ``place`` replaced, put in before, or taken out."""
    if kind == "insertion":
        return window[:place] + [fresh] + window[place:]
    return window[:place] + ([fresh] if kind == "substitution" else []) + window[place + 1 :]


KINDS = ("substitution", "insertion", "deletion")


@functools.cache
def repetitions(n: int, max_edits: int, recall: float, samples: int) -> int:
    """Repetitions after which a pair of windows at that edit distance shares a key with probability ``recall``, whatever the kind of edit."""
    if max_edits == 0:
        return 1
    rng = np.random.default_rng(n)
    trials = 1_000
    missed = []
    for kind in KINDS:
        # pairs differ in how likely they share a key, so repetitions are tried on the same pairs instead of taking powers of a rate
        a = rng.integers(0, 1 << 62, (trials, n)).tolist()
        b = a
        for _ in range(max_edits):
            b = [with_edit(w, int(rng.integers(1, len(w))), kind, int(rng.integers(0, 1 << 62))) for w in b]
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        missed.append((x, y, np.ones(trials, bool)))
    for turn in range(200):
        for x, y, open_ in missed:
            keys = [cgk_keys(w.ravel(), np.arange(trials) * w.shape[1], n, [w.shape[1]], turn, samples)[0] for w in (x, y)]
            open_ &= keys[0] != keys[1]
        if max(open_.mean() for _, _, open_ in missed) <= 1 - recall:
            return turn + 1
    raise ValueError("no number of repetitions reaches that recall")


#: Kinds of windows: units and item size. Items take the second where they are mostly Han.
MODES: list[tuple[Callable, int]] = [(word_units, WORDS), (char_units, CHARS)]


class Search:
    """How keys are made: sent to every task."""

    def __init__(self, max_edits: int, recall: float):
        self.edits = max_edits
        self.samples = SAMPLES_WITH_EDITS if max_edits else SAMPLES
        self.turns = [repetitions(n, max_edits, recall, self.samples) for _, n in MODES]

    def sizes(self, n: int) -> list[int]:
        return list(range(n - self.edits, n + self.edits + 1))

    def item_windows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, item_id, place, wanted): every window of every item with each of its keys."""
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            windows: list[bytes] = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("body").to_pylist()):
                points = code_points(text)
                mode = int(mostly_han(points))
                to_units, n = MODES[mode]
                units, _ = to_units(points)
                starts = np.arange(len(units) - n + 1) if len(units) >= n else np.zeros(0, np.int64)
                if not len(starts):
                    continue
                own = [units[s : s + n].tobytes() for s in starts]
                for turn in range(self.turns[mode]):
                    out[0].append(cgk_keys(units, starts, n, [n], turn, self.samples)[0].view(np.int64))
                    out[1].append(np.full(len(starts), item, np.int64))
                    out[2].append(starts.astype(np.int32))
                    windows += own
            if out[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in out), pa.array(windows, pa.binary())], names=["key", "item_id", "place", "wanted"])

    def document_windows(self, bits: Callable[[], bytes]) -> Callable:
        """(key, doc_id, held): windows of documents whose key may be an item's."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.frombuffer(bits(), np.uint64)
            mask = np.uint64(64 * len(table) - 1)
            _, han = _kinds()

            def known(keys: np.ndarray) -> np.ndarray:
                hit = np.flatnonzero(_bit(table, keys & mask))
                return hit[_bit(table, (keys[hit] >> np.uint64(33)) & mask)]

            for batch in batches:
                ids, texts = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
                k = 0
                while k < len(texts):
                    points, owners, size = [], [], 0
                    while k < len(texts) and (size == 0 or size < CHUNK):
                        points.append(code_points(texts[k]))
                        owners.append(k)
                        size += len(points[-1]) + 1
                        k += 1
                    for mode, (to_units, n) in enumerate(MODES):
                        own = [(o, p) for o, p in zip(owners, points) if mode == 0 or han[p].any()]
                        if not own:
                            continue
                        # one blank parts the texts; its place tells which text a unit belongs to
                        units, at = to_units(np.concatenate([np.append(p, np.uint32(32)) for _, p in own]))
                        sizes = self.sizes(n)
                        if len(units) < sizes[0]:
                            continue
                        text_of = np.searchsorted(np.cumsum([len(p) + 1 for _, p in own]), at, "right")
                        starts = np.flatnonzero(text_of[: len(units) - sizes[0] + 1] == text_of[sizes[0] - 1 :])
                        docs = ids[np.array([o for o, _ in own])]
                        for turn in range(self.turns[mode]):
                            for m, keys in zip(sizes, cgk_keys(units, starts, n, sizes, turn, self.samples)):
                                hit = known(keys)
                                first = starts[hit]
                                fits = first + m <= len(units)
                                hit, first = hit[fits], first[fits]
                                fits = text_of[first] == text_of[first + m - 1]
                                hit, first = hit[fits], first[fits]
                                if len(hit):
                                    yield pa.RecordBatch.from_arrays(
                                        [pa.array(keys[hit].view(np.int64)), pa.array(docs[text_of[first]].astype(np.int64)), pa.array([units[s : s + m].tobytes() for s in first], pa.binary())],
                                        names=["key", "doc_id", "held"],
                                    )

        return run

    def verify(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item_id, doc_id, place) of the pairs whose windows are within the edits."""
        for batch in batches:
            wanted, held = batch.column("wanted").to_pylist(), batch.column("held").to_pylist()
            shapes = np.array([len(a) * 1_000 + len(b) // 8 for a, b in zip(wanted, held)], np.int64)
            ok = np.zeros(len(wanted), bool)
            for shape in np.unique(shapes).tolist():
                rows = np.flatnonzero(shapes == shape)
                a, b = (np.frombuffer(b"".join(x[r] for r in rows), np.uint64).reshape(len(rows), -1) for x in (wanted, held))
                ok[rows] = within_edits(a, b, self.edits)
            if ok.any():
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("item_id", "doc_id", "place")], names=["item_id", "doc_id", "place"])


def _bit(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (table[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1) == 1


def key_filter(keyed: DataFrame) -> bytes:
    """A Bloom filter of ``keyed(key)`` with two bits for each key, as 64-bit words; no more than ``FILTER_BITS`` bits."""
    size = min(FILTER_BITS, 1 << max(16, (16 * keyed.count() - 1).bit_length()))
    words = sql(
        keyed.sparkSession,
        """
        SELECT place div 64 AS word, bit_or(shiftleft(1L, CAST(place % 64 AS INT))) AS bits
        FROM (SELECT explode(array(key & {mask}L, shiftrightunsigned(key, 33) & {mask}L)) AS place FROM {keyed}) GROUP BY place div 64""",
        keyed=keyed,
        mask=size - 1,
    ).toPandas()  # no more than FILTER_BITS / 64 rows, whatever the items are
    table = np.zeros(size // 64, np.uint64)
    table[words.word.to_numpy()] = words.bits.to_numpy(np.int64).view(np.uint64)
    return table.tobytes()


def item_bodies(items: DataFrame) -> DataFrame:
    """(item_id, body): item texts without an opening sentence that several items share."""
    return sql(
        items.sparkSession,
        r"""
        WITH parted AS (
          SELECT DISTINCT item_id, text, regexp_extract(text, r'^(?s)(.*?(?:[.!?](?=\s)|[。！？]))(.+)$', 1) AS opening,
                 regexp_extract(text, r'^(?s)(.*?(?:[.!?](?=\s)|[。！？]))(.+)$', 2) AS rest
          FROM {items} WHERE text IS NOT NULL),
        shared AS (SELECT lower(trim(opening)) AS opening FROM parted WHERE opening <> '' GROUP BY lower(trim(opening)) HAVING count(DISTINCT rest) > 1)
        SELECT item_id, IF(s.opening IS NULL, text, rest) AS body FROM parted p LEFT JOIN shared s ON lower(trim(p.opening)) = s.opening""",
        items=items,
    )


def leaked_windows(documents: DataFrame, items: DataFrame, max_edits: int = 0, recall: float = 0.95) -> DataFrame:
    """(item_id, doc_id, n_windows): pairs with at least one common window, and how many of the item's windows are found."""
    spark = documents.sparkSession
    search = Search(max_edits, recall)
    keyed = cut_lineage(item_bodies(items).mapInArrow(search.item_windows, "key long, item_id long, place int, wanted binary"))
    bits = spark.sparkContext.broadcast(key_filter(keyed))
    texts = documents.selectExpr("doc_id AS doc", "text").where("text IS NOT NULL AND doc IS NOT NULL")
    held = texts.mapInArrow(search.document_windows(lambda: bits.value), "key long, doc_id long, held binary")
    pairs = held.join(keyed, "key").select("item_id", "doc_id", "place", "wanted", "held")
    found = pairs.mapInArrow(search.verify, "item_id long, doc_id long, place int")
    return found.groupBy("item_id", "doc_id").agg(F.count_distinct("place").alias("n_windows"))
