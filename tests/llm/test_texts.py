"""Languages, scans and pairs of items."""

import json
import math
import random
from collections import Counter
from itertools import combinations, product

from marginalia.llm import cooccurrence, language, ocr

I = "item_key string, title string, language string, abstract_note string, label string, text string, seg_no int"
TALK = {
    "en": ["the pump moved warm water through the long pipe of the house", "we measured the air in every room before the guests came", "a small window kept the heat inside during the night"],
    "de": ["die pumpe bewegt warmes wasser durch das lange rohr des hauses", "wir haben die luft in jedem raum gemessen bevor die leute kamen", "ein kleines fenster hielt die wärme in der nacht im zimmer"],
    "fr": ["la pompe fait passer l'eau chaude dans le long tuyau de la maison", "nous avons mesuré l'air de chaque pièce avant la venue des gens", "une petite fenêtre garde la chaleur pendant toute la nuit"],
    "es": ["la bomba mueve el agua caliente por el tubo largo de la casa", "medimos el aire de cada cuarto antes de que llegara la gente", "una ventana pequeña guarda el calor durante toda la noche"],
    "zh": ["水泵把热水送进房屋的长管道里面", "我们在客人到来之前测量了每个房间的空气", "小窗户在夜间把热量留在室内"],
    "ja": ["ポンプは家の長い管に温かい水を送っている", "お客が来る前にすべての部屋の空気を測った", "小さな窓は夜のあいだ熱を部屋に保っている"],
}


def talk(rng, code, n):
    end = "。" if code in ("zh", "ja") else ". "
    cut = lambda s: s if code in ("zh", "ja") else " ".join(rng.sample(s.split(), len(s.split())))
    return end.join(cut(rng.choice(TALK[code])) for _ in range(n)) + end


def naive_phrases(text, sample):
    n = i = 0
    while i < len(text):
        k = i + 1
        while k <= len(text) and text[i:k] in sample:
            k += 1
        i = max(i + 1, k - 1)
        n += 1
    return n


def test_phrases_against_a_naive_parse():
    rng = random.Random(1)
    sample = "".join(rng.choices("abc ", k=400))
    automaton = language.Automaton(sample)
    texts = sorted(("".join(rng.choices("abc d热", k=rng.randint(1, 60))) for _ in range(200)), key=lambda t: -len(t))
    import numpy as np

    width = len(texts[0])
    codes = np.frombuffer("".join(t.ljust(width) for t in texts).encode("utf-32-le"), np.uint32).astype(np.uint16).reshape(len(texts), width)
    found = automaton.phrases(codes, np.array([len(t) for t in texts]))
    assert found.tolist() == [naive_phrases(t, sample) for t in texts]


def test_languages(spark):
    rng = random.Random(2)
    items = []
    for code in TALK:
        for k in range(30):
            items.append((f"{code}{k}", "t", language.NAMES[code][k % 3], talk(rng, code, 5), "x", "y", 1))
    items += [
        ("wrong", "t", "fr-FR", talk(rng, "en", 4), "", "", 0),
        ("none", "t", None, talk(rng, "de", 4), "", "", 0),
        ("right", "t", "EN_gb", talk(rng, "en", 4), "", "", 0),
        ("mixed", "t", "en", talk(rng, "en", 3) + "\n" + talk(rng, "zh", 3) + talk(rng, "es", 3), "", "", 0),
        ("title", TALK["es"][0], "", None, "", "", 0),
        ("odd", "t", "klingon", talk(rng, "ja", 3), "", "", 0),
        ("empty", None, "en", None, "", "", 0),
        ("blank", " ", None, "  ", "", "", 0),
        ("long", "t", "en", talk(rng, "fr", 3000), "", "", 0),
    ]
    found = {}
    for r in language.language_cases(spark.createDataFrame(items * 2, I)).collect():
        found.setdefault(r.item_key, []).append((r.seg_no, r.language))
        assert 0 <= r.confidence <= 1
    assert {k: sorted(v) for k, v in found.items()} == {
        "wrong": [(1, "en")], "none": [(1, "de")], "mixed": [(1, "en"), (2, "zh"), (3, "es")], "title": [(1, "es")], "odd": [(1, "ja")], "long": [(1, "fr")],
    }


def test_no_labels_and_no_rows(spark):
    assert language.language_cases(spark.createDataFrame([], I)).count() == 0
    assert language.language_cases(spark.createDataFrame([("a", "t", None, "some text here", "", "", 0)], I)).count() == 0


P = "attachment_key string, status string, text string, line_no int, kind string"
NOISE = [("i", "l"), ("e", "c"), ("n", "ri"), ("d", "cl"), ("t", "f"), ("m", "rn"), ("o", "0"), ("u", "ii")]
VOCABULARY = (
    "between pressure building remained condition temperature measured different window ventilation operator afternoon continued instruments direction machine "
    "moderate standard increased reported discomfort laboratory minimum radiant located garden number distance medium turbine seasonal document"
).split()


def pages(rng, noisy, n_pages=3):
    """Text of pages with furniture, cut words and misread words, and the true cases."""
    lines, cases, number = [], set(), rng.randint(5, 400)
    for p in range(1, n_pages + 1):
        lines += [f"===== Page {p} OCR =====", ""]
        lines.append("JOURNAL OF WARM ROOMS AND WINDOWS")
        cases.add((len(lines), "furniture", ""))
        for _ in range(18):
            words = [rng.choice(VOCABULARY) for _ in range(8)]
            cut = rng.random() < 0.15
            for k in range(1, 7):
                if noisy and rng.random() < 0.04:
                    a, b = rng.choice(NOISE)
                    if a in words[k] and len(words[k]) > 4:
                        wrong = words[k].replace(a, b, 1)
                        cases.add((len(lines) + 1, "misread", words[k]))
                        words[k] = wrong
            if cut:
                whole = words[-1]
                words[-1] = whole[:3] + "-"
                cases.add((len(lines) + 1, "hyphen", whole))
                lines.append(" ".join(words))
                lines.append(" ".join([whole[3:] + ",", *(rng.choice(VOCABULARY) for _ in range(6))]))
            else:
                lines.append(" ".join(words))
        lines.append(f"· {number + p} ·")
        cases.add((len(lines), "furniture", ""))
        lines += ["", ""]
    return "\n".join(lines), cases


def test_repair_finds_the_planted_cases(spark):
    rng = random.Random(4)
    made = {f"K{k}": pages(rng, True) for k in range(60)}
    rows = [(k, "ok", t, 1, "x") for k, (t, _) in made.items()] * 2 + [("n", "error", None, 0, ""), ("e", "ok", "", 0, ""), ("z", "ok", "温度升高。\n第 3 页", 0, "")]
    found = {}
    for r in ocr.repair_cases(spark.createDataFrame(rows, P)).collect():
        found.setdefault(r.attachment_key, set()).add((r.line_no, r.kind, r.fixed))
    true = {(k, *c) for k, (_, cases) in made.items() for c in cases}
    got = {(k, *c) for k, cases in found.items() if k in made for c in cases}
    for kind, least in (("furniture", 0.98), ("hyphen", 0.95), ("misread", 0.85)):
        t, g = {x for x in true if x[2] == kind}, {x for x in got if x[2] == kind}
        assert len(t & g) >= least * len(t) and len(t & g) >= least * len(g), (kind, len(t), len(g), len(t & g), sorted(g - t)[:5], sorted(t - g)[:5])
    assert "n" not in found and "e" not in found
    assert all(kind == "furniture" for _, kind, _ in found.get("z", []))
    text = " ".join(r.text for r in ocr.repaired_paragraphs(spark.createDataFrame(rows[:1], P)).collect())
    assert "=====" not in text


def test_kinds_of_misreadings_are_counted_over_all_words(spark):
    rights = [w for w in VOCABULARY if w.count("m") == 1 and len(w) >= 6]
    han = [chr(0x4E00 + k % 20_000) + chr(0x4E00 + k // 20_000) for k in range(60_000)]
    text = " ".join(" ".join(rights) for _ in range(40)) + "\n" + " ".join(w.replace("m", "rn") for w in rights) + "\n"
    rows = [("a", "ok", text, 0, "")] + [(f"h{k}", "ok", " ".join(han[k : k + 1000]), 0, "") for k in range(0, len(han), 1000)]
    found = ocr.repair_cases(spark.createDataFrame(rows, P)).where("kind = 'misread'").select("attachment_key", "fixed").collect()
    assert len(rights) >= 6 and {tuple(r) for r in found} == {("a", w) for w in rights}


def test_every_usual_kind_has_examples(spark):
    words = [("".join(random.Random(k).choices("abdfgh", k=9)), k) for k in range(9_000)]
    found = [(w + "rn", w + "m", "rn", "m") for w, _ in words] + [(w + "cl", w + "d", "cl", "d") for w, k in words if k < 60]
    drawn = ocr.training_pairs(spark.createDataFrame(sorted(set(found)), "word string, right string, wrong string, op string"))
    assert len(drawn) <= ocr.TRAIN_PAIRS and sum(w.endswith("cl") for w, _ in drawn) >= ocr.KIND_PAIRS


def test_repair_without_rows(spark):
    assert ocr.repair_cases(spark.createDataFrame([], P)).count() == 0
    assert ocr.repair_cases(spark.createDataFrame([("a", "ok", "word " * 20_000, 0, "")], P)).where("kind = 'misread'").count() == 0


def test_operations_give_the_right_word():
    for wrong, right in (("carbori", "carbon"), ("racliant", "radiant"), ("llnk", "link"), ("modem", "modern"), ("abc", "abc"), ("xaybzc", "abc")):
        ops = ocr.gold_operations(wrong, right)
        if ops:
            assert "".join(c if o == ocr.KEEP else "" if o == ocr.DELETE else o for c, o in zip(wrong, ops)) == right
    assert ocr.gold_operations("xaybzc", "abc") is None


def test_pairs_against_brute_force(spark):
    rng = random.Random(7)
    schema = "item_key string, tags_json string, kind string, value string, members string"
    rows = []
    for k in range(400):
        tags = [f"t{int(rng.paretovariate(0.6)) % 40}" for _ in range(rng.randint(0, 7))]
        rows.append((f"i{k}", rng.choice([json.dumps(tags), json.dumps([f" {t} " for t in tags] + ["", None])]), "x", "y", "z"))
    rows += rows[:50] + [("null", None, "", "", ""), ("bad", "{", "", "", ""), ("empty", "[]", "", "", ""), (None, '["t1", "t2"]', "", "", ""), ("big", json.dumps([f"u{k}" for k in range(1500)]), "", "", "")]
    baskets = {}
    for key, cell, *_ in rows:
        if key and cell and cell != "{":
            values = {t.strip() for t in json.loads(cell) if t and t.strip()}
            if values:
                baskets.setdefault(key, set()).update(values)
    n = Counter(x for b in baskets.values() for x in b)
    both = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    expected = {(a, b): (c, n[a], n[b], len(baskets)) for (a, b), c in both.items() if c >= 5 and c * len(baskets) >= 4 * n[a] * n[b]}
    found = cooccurrence.pair_counts(spark.createDataFrame(rows, schema), "item_key", {"tag": "tags_json"}).collect()
    assert {(r.left_value, r.right_value): (r.n_both, r.n_left, r.n_right, r.n_all) for r in found} == expected
    assert all(math.isclose(r.pmi, math.log2(r.lift)) for r in found)
    assert cooccurrence.pair_counts(spark.createDataFrame([], schema), "item_key", {"tag": "tags_json"}).count() == 0


def test_figures_and_joins_are_learnt():
    lexicon = {w: 50 for w in ("consecutive", "perature", "tracer-gas", "tracer", "gas", "low-temperature", "low", "temperature", "ventilated", "ceiling", "mounted", "floor", "phase-change", "phase", "change")}
    editor = ocr.Editor(ocr.Perceptron(), {}, lexicon, ocr.train_joins(lexicon), ocr.train_figures())
    for wrong, right in (("3l.9l", "31.91"), ("S1.3", "51.3"), ("B2.9", "82.9"), ("l2.O", "12.0"), ("12.5", None), ("SO.l", None)):
        assert editor.figure(wrong) == right
    for head, tail, right in (("con-", "secutive", "consecutive"), ("tracer-", "gas", "tracer-gas"), ("Low-", "temperature", "Low-temperature"), ("ceiling-", "mounted", "ceiling-mounted"), ("venti-", "lated", "ventilated")):
        assert ocr.join_word(head, tail, editor) == right


def test_the_tail_of_the_lexicon_is_known_too(spark, monkeypatch):
    """With room for a few words only, words beyond them aren't repaired into others, and the rest still is."""
    frequent = " ".join(["window pattern signal"] * 400)
    rare = " ".join(["siqnal"] * 3 + ["windovv"] * 2)
    learnt = " ".join(f"{w} {w}" for w in ("qattern", "patfern", "sifnal", "vvindow"))
    rows = [("a", "ok", f"{frequent} {rare} {learnt}", 0, "")]
    monkeypatch.setattr(ocr, "LEXICON", 3)
    monkeypatch.setattr(ocr, "RATIO", 1_000)
    model = ocr.Model(ocr.page_texts(spark.createDataFrame(rows, P)))
    assert set(model.lexicon) == {"window", "pattern", "signal"}
    assert {r.word for r in model.tail.collect()} == {"siqnal"}
    editor = ocr.Editor(*model.parts())
    assert editor.may_be_known("siqnal")


def test_any_size_of_the_lexicon_gives_the_same_repairs(spark, monkeypatch):
    """Known words beyond those held in memory are what misreadings stand for, too, and parts of cut words; paragraphs hold the repairs."""
    rng = random.Random(9)
    rows = [(f"K{k}", "ok", pages(rng, True)[0], 0, "") for k in range(40)] + [("h", "ok", " ".join(["tracer-gas low-pressure"] * 3) + "\nof tracer-\ngas and low-\npressure", 0, "")]
    texts = spark.createDataFrame(rows, P)

    def results():
        return [sorted(tuple(r) for r in f(texts).collect()) for f in (ocr.repair_cases, ocr.repaired_paragraphs)]

    whole = results()
    assert sum(kind == "misread" for _, _, kind, _ in whole[0]) > 100
    monkeypatch.setattr(ocr, "LEXICON", 7)
    assert results() == whole


def test_no_edit_is_dropped_for_better_scored_ones():
    """However many beginnings score better, the only known word that a misreading leads to is found."""
    model = ocr.Perceptron()
    model.weights = {("ca", label): score for label, score in (("=", 3.0), ("x", 2.0), ("y", 1.0))}
    lexicon = {"".join(w) + "q": 9 for w in product("axy", repeat=6)} | {"yyyyyyz": 9}
    assert ocr.Editor(model, {"a": ["=", "x", "y"]}, lexicon).decode("aaaaaaz", 5) == "yyyyyyz"


def test_words_of_the_tail_are_looked_up(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abcé温-", k=rng.randint(1, 6))): rng.randint(3, 90) for _ in range(3 * ocr.BLOCK + 1)}
    tail = ocr.write_tail(spark.createDataFrame(list(words.items()), "word string, n long"))
    asked = set(words) | {w[:k] for w in words for k in range(len(w))} | {"".join(rng.choices("abcé温-z", k=3)) for _ in range(300)}
    assert {w: tail.count(w) for w in asked} == {w: words.get(w, 0) for w in asked}
    assert {w: tail.begins(w) for w in asked} == {w: any(x.startswith(w) for x in words) for w in asked}
    assert dict(tail.items()) == words
    assert ocr.write_tail(spark.createDataFrame([], "word string, n long")) is None


def test_rare_kinds_of_misreading_are_found(spark):
    """Two letters read for one, in the few words where they occur, are repaired however many other misreadings there are."""
    rng = random.Random(12)
    plain = ["".join(rng.choices("abeghkopstuvwz", k=8)) for _ in range(60)]
    body = " ".join(plain * 600) + " " + " ".join(["alternative returned nocturnal"] * 600)
    noise = " ".join({w[:k] + "x" + w[k + 1 :] for w in plain for k in range(1, 8)}) + " altemative retumed " * 4
    rows = [("a", "ok", body, 0, ""), ("b", "ok", f"some {noise} text", 0, "")]
    fixed = [r.fixed for r in ocr.repair_cases(spark.createDataFrame(rows, P)).where("kind = 'misread' AND attachment_key = 'b'").collect()]
    assert {"alternative", "returned"} <= set(fixed)
