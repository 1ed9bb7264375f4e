"""Windows, spans and containers over documents."""

import random
import unicodedata

import numpy as np
import pytest
import re

from marginalia.llm import contamination, packing, spans
from marginalia.llm.rolling import codes, window_hashes

DOCS = "doc_id long, text string, doc long, place int, hash long"
ITEMS = "item_id long, text string, body string, doc_id long"


def documents(spark, texts):
    return spark.createDataFrame([(k, t, 1, 2, 3) for k, t in enumerate(texts)], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13])
def test_cover_has_every_distance(q):
    period, cover = spans.difference_cover(q)
    assert (period, len(cover)) == (q * q + q + 1, q + 1)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_equal_windows_have_equal_hashes():
    text = codes("热" * 3 + "abcab" * 40)
    starts = np.arange(len(text) - 20)
    for which in (0, 1):
        h = window_hashes(text, starts, 20, which)
        for s in range(10, 60):
            for t in range(10, 60):
                assert (h[s] == h[t]) == ((text[s : s + 20] == text[t : t + 20]).all())


def brute_spans(texts, length):
    seen = {}
    for k, t in enumerate(texts):
        for p in range(len(t or "") - length + 1):
            seen.setdefault(t[p : p + length], set()).add(k)
    out = set()
    for k, t in enumerate(texts):
        covered = bytearray(len(t or ""))
        for p in range(len(t or "") - length + 1):
            if len(seen[t[p : p + length]]) > 1:
                covered[p : p + length] = b"\1" * length
        for m in re.finditer(b"\1+", bytes(covered)):
            out.add((k, m.start(), m.end()))
    return out


def test_spans_against_brute_force(spark):
    rng = random.Random(1)
    shared = [words(rng, 120) for _ in range(5)] + ["热舒适" * 200]
    texts = [None, "", "short", "a" * 1000, "a" * 700, shared[0], shared[0], shared[0][:-1]]
    for _ in range(40):
        t = words(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            t += s[a : a + rng.choice([100, 239, 240, 241, 400, 2000])] + words(rng, rng.randint(0, 20))
        texts.append(t)
    texts.append(words(rng, 9000) + shared[1])
    found = {tuple(r) for r in spans.shared_spans(documents(spark, texts)).collect()}
    assert found == brute_spans(texts, 240)
    share = {r.doc_id: r for r in spans.shared_share(documents(spark, texts)).collect()}
    assert len(share) == len(texts) and share[0].share == 0.0 and share[5].share == 1.0


def test_spans_small_and_empty(spark):
    assert spans.shared_spans(documents(spark, [])).count() == 0
    assert spans.shared_spans(documents(spark, ["x" * 500])).count() == 0
    assert spans.shared_spans(documents(spark, [None, None, ""])).count() == 0


def brute_leaks(items, texts):
    norm = lambda t: unicodedata.normalize("NFKC", t).casefold()
    word = lambda t: re.findall(r"[^\W_]+", norm(t))
    char = lambda t: "".join(c for c in norm(t) if c.isalnum())
    out = set()
    for i, item in items:
        zh = len(re.findall("[一-鿿]", item)) * 2 > len(char(item))
        unit, n = (char, 24) if zh else (word, 12)
        wanted = {tuple(unit(item)[k : k + n]) for k in range(len(unit(item)) - n + 1)}
        out |= {(i, d) for d, t in enumerate(texts) if t and any(tuple(unit(t)[k : k + n]) in wanted for k in range(len(unit(t)) - n + 1))}
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    head = "Read the log below and answer it in one of the three ways that are given here. "
    english = [words(rng, 40) for _ in range(12)]
    chinese = ["".join(rng.choices("热舒适温度湿空气流动辐射板墙体能耗", k=60)) for _ in range(6)]
    items = [(k, (head if k % 2 else "") + t) for k, t in enumerate(english + chinese)] + [(90, "too short"), (91, None), (92, "")]
    texts = [None, "", head * 3]
    for _ in range(60):
        t = words(rng, rng.randint(0, 30))
        s = rng.choice(english).split()
        a, n = rng.randrange(20), rng.choice([8, 11, 12, 13, 30])
        piece = " ".join(s[a : a + n])
        piece = rng.choice([piece, piece.upper(), piece.replace(" ", ", "), piece.replace(" ", "\n"), "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in piece)])
        z = rng.choice(chinese)
        b, m = rng.randrange(30), rng.choice([10, 23, 24, 40])
        texts.append(t + ". " + piece + "; " + words(rng, 5) + "。" + "，".join(z[b : b + m]) + "。")
    table = spark.createDataFrame([(i, t, "b", 7) for i, t in items] * 2, ITEMS)
    found = {(r.item_id, r.doc_id) for r in contamination.leaked_windows(documents(spark, texts), table).collect()}
    bodies = [(r.item_id, r.body) for r in contamination.item_bodies(table).collect()]
    assert all(not b.startswith("Read the log") for _, b in bodies)
    assert found == brute_leaks([(i, b) for i, b in bodies if b], texts)
    assert len(found) > 20


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_edit_verification_against_brute_force():
    rng = np.random.default_rng(3)
    for n, m, most in ((12, 12, 0), (12, 12, 1), (12, 13, 1), (12, 11, 1), (7, 9, 2), (7, 7, 3), (5, 8, 2)):
        a = rng.integers(0, 3, (300, n)).astype(np.uint64)
        b = np.concatenate([a, rng.integers(0, 3, (300, 8)).astype(np.uint64)], axis=1)[:, :m]
        b[::3] = rng.integers(0, 3, b[::3].shape)
        b[1::3, m // 2] = 9
        assert contamination.within_edits(a, b, most).tolist() == [brute_edits(x, y) <= most for x, y in zip(a.tolist(), b.tolist())]


@pytest.mark.parametrize("chinese", [False, True])
def test_every_kind_of_edit_reaches_the_target_recall(spark, chinese):
    """An item of one window, with one edit at an inner place: 0.9 of each kind are found, end to end."""
    rng = random.Random(10)
    n = contamination.CHARS if chinese else contamination.WORDS
    fresh = (lambda: chr(rng.randint(0x4E00, 0x9F00))) if chinese else (lambda: "".join(rng.choices("abcdefghijklmnop", k=8)))
    join = "".join if chinese else " ".join
    items, docs, kinds = [], [], {}
    for k in range(360):
        units = [fresh() for _ in range(n)]
        kind = contamination.KINDS[k % 3]
        place = rng.randint(1, n - 1 if kind == "insertion" else n - 2)
        items.append((k, join(units), "", 0))
        docs.append("\n".join(join([fresh() for _ in range(9)]) for _ in range(2)) + ". " + join(contamination.with_edit(units, place, kind, fresh())) + ". " + join([fresh() for _ in range(9)]))
        kinds[k] = kind
    found = {(r.item_id, r.doc_id) for r in contamination.leaked_windows(documents(spark, docs), spark.createDataFrame(items, ITEMS), max_edits=1).collect()}
    assert all(i == d for i, d in found)
    for kind in contamination.KINDS:
        assert sum(kinds[i] == kind for i, _ in found) >= 0.9 * 120, kind
    assert contamination.leaked_windows(documents(spark, docs), spark.createDataFrame(items, ITEMS)).count() == 0


def test_a_small_filter_loses_nothing(spark, monkeypatch):
    rng = random.Random(11)
    texts = [words(rng, 60) for _ in range(30)]
    table = spark.createDataFrame([(k, t, "", 0) for k, t in enumerate(texts)], ITEMS)
    docs = documents(spark, [" ".join(t.split()[9:40]) for t in texts] + [None, "x"])
    monkeypatch.setattr(contamination, "FILTER_BITS", 64)
    found = {(r.item_id, r.doc_id, r.n_windows) for r in contamination.leaked_windows(docs, table).collect()}
    assert found == {(k, k, 20) for k in range(30)}


def test_leaks_empty(spark):
    none = spark.createDataFrame([], ITEMS)
    assert contamination.leaked_windows(documents(spark, ["a b c"]), none).count() == 0
    assert contamination.leaked_windows(documents(spark, []), spark.createDataFrame([(1, words(random.Random(1), 30), "", 0)], ITEMS)).count() == 0


def test_windows_hold_everything_and_never_too_much():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 40, 400):
        for top in (40, 60, 100):
            sizes = rng.integers(1, top + 1, n)
            window, m = packing.windows(sizes, 100)
            sums = np.bincount(window, sizes, m)
            assert len(window) == n and (sums <= 100).all()
            assert m <= max(1, -(-sizes.sum() // 100) + (0.08 * m + 1 if top <= 60 else m))


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(5).integers(1, 100, 300)
    sums = np.bincount(packing.differencing(sizes, 20), sizes, 20)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 5
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]


def test_containers(spark):
    rng = random.Random(6)
    texts = [None, "", "one", words(rng, 9000), *(words(rng, rng.randint(1, 400)) for _ in range(120)), "same", "same"]
    df = documents(spark, texts)
    counts = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    packed = packing.pack(df, shard_tokens=20_000).collect()
    fill = {}
    for r in packed:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert max(fill.values()) <= 2048
    assert sum(fill.values()) / (2048 * len(fill)) > 0.9
    for k in range(len(texts)):
        own = sorted((r.piece, r.token_start, r.n_tokens) for r in packed if r.doc_id == k)
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for _, _, n in own) == counts[k]
        assert len(own) == max(1, -(-counts[k] // 2048))
        assert [s for _, s, _ in own] == [2048 * p for p, _, _ in own]
    assert packing.pack(documents(spark, [])).count() == 0
