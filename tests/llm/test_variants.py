import json
import random

import pandas as pd

from marginalia.llm import variants

CARDS = "card_id string, first_author_affiliation string, first_author_affiliation_raw string, stem string, field string, name string"
ITEMS = "item_key string, creators_json string, spelling string, given string"


def person(first, last):
    return {"creatorType": "author", "firstName": first, "lastName": last}


def groups(rows, kind):
    out = {}
    for r in rows:
        if r.kind == kind:
            assert r.name_a < r.name_b
            out.setdefault(r.name_a, {r.name_a}).add(r.name_b)
    return sorted((sorted(x) for x in out.values()), key=lambda x: (-len(x), x))


def test_organisations(spark):
    cards = [
        ("1", "Fitelehomi University, China", "a Dept of X, Fitelehomi University, Tan 1, China", "", "", ""),
        ("2", "FITELEHOMI UNIVERSITY", None, "", "", ""),
        ("3", "University of Fitelehomi", "?", "", "", ""),
        ("4", "Fitelhomi Unversity, China", None, "", "", ""),
        ("5", "Fitelehomi Institute of Building Research, China", None, "", "", ""),
        ("6", "湖畔大学，建筑系", "湖畔大学 (Fitelehomi University), Tan 1, China; b School, Other Univ., Italy", "", "", ""),
        ("7", "未填写", "Fitelehomi Univ., China", "", "", ""),
        ("8", None, None, "", "", ""),
        ("8", "Zubetososti Polytechnic", None, "", "", ""),
        ("9", "x" * 20_000, None, "", "", ""),
    ] * 2
    items = spark.createDataFrame([], ITEMS)
    found = variants.name_variants(spark.createDataFrame(cards, CARDS), items).collect()
    assert groups(found, "affiliation")[0] == sorted(
        ["Fitelehomi University, China", "FITELEHOMI UNIVERSITY", "University of Fitelehomi", "Fitelhomi Unversity, China", "湖畔大学，建筑系", "Fitelehomi Univ., China"]
    )
    assert len(found) == 15


def test_people(spark):
    names = [
        [person("Robert", "Betubohafu"), person("Bob", "Betubohafu"), person("R.", "Betubohafu"), person("RN", "Betubohafu"), person("Betubohafu", "R")],
        [person("Robert", "BETUBOHAFU"), person("Robetr", "Betubohafu"), person("Robert N.", "Betubohafu"), person("", "Betubohafu, Robert"), person("Robert", "Betubóhafu"), person("Robert", "Betub-Ohafu")],
        [person("Victoria", "Betubohafu"), person("Vicky", "Betubohafu"), person("V.", "Betubohafu")],
        [person("Thomas", "Krufesafutra"), person("Theodora", "Krufesafutra"), person("T.", "Krufesafutra")],
        [{"creatorType": "author", "name": "林和"}, {"creatorType": "author", "name": "林书"}, {"creatorType": "author", "name": ""}, person(None, None)],
    ]
    items = [(str(k), json.dumps(x, ensure_ascii=False), "s", "g") for k, x in enumerate(names)] * 2 + [("n", None, "", ""), ("b", "no list", "", ""), ("e", "[]", "", "")]
    found = variants.name_variants(spark.createDataFrame([], CARDS), spark.createDataFrame(items, ITEMS)).collect()
    g = groups(found, "creator")
    assert set(g[0]) >= {"Robert Betubohafu", "Bob Betubohafu", "R. Betubohafu", "RN Betubohafu", "Betubohafu R", "Robert BETUBOHAFU", "Robetr Betubohafu", "Robert N. Betubohafu", "Betubohafu, Robert", "Robert Betubóhafu", "Robert Betub-Ohafu"}
    linked = {frozenset((r.name_a, r.name_b)) for r in found}
    assert frozenset(("Vicky Betubohafu", "Victoria Betubohafu")) in linked and frozenset(("V. Betubohafu", "Victoria Betubohafu")) in linked
    for a, b in (("Robert Betubohafu", "Victoria Betubohafu"), ("Theodora Krufesafutra", "Thomas Krufesafutra"), ("T. Krufesafutra", "Thomas Krufesafutra"), ("林和", "林书")):
        assert frozenset((a, b)) not in linked


def test_family_names_borne_by_many(spark):
    given = ["Zebulon", "Alexander", *("".join(random.Random(k).choices("bdfgklmn", k=7)).title() for k in range(40))]
    plain = [f"{g} {f}" for f in ("Smith", "Kruger") for g in given]
    for more in ([], plain):  # further bearers change nothing
        names = ["Smith, Zebulon", "Zebulon SMITH", "Zebulon Smith", "Smith Zebulon", "Alexander Smith", "Smith, Alexander", *more]
        families = {r.spelling: r.family for r in variants.parse_people(spark.createDataFrame([(n,) for n in sorted(set(names))], "spelling string")).collect()}
        assert families == {n: "kruger" if "Kruger" in n else "smith" for n in families}


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


def test_lcs_against_brute_force():
    rng = random.Random(5)
    a = ["".join(rng.choices("abcd热", k=rng.choice([0, 1, 5, 30, 63, 64, 65, 90]))) for _ in range(150)]
    b = ["".join(rng.choices("abcd热", k=rng.choice([0, 1, 6, 31, 63, 64, 65, 90]))) for _ in range(150)]
    assert variants.lcs_lengths(pd.Series(a), pd.Series(b)).tolist() == [brute_lcs(x, y) for x, y in zip(a, b)]


def test_blocking_keeps_every_near_pair(spark):
    rng = random.Random(6)
    stems = {"".join(rng.choices("abdegiklmoprstuv", k=rng.randint(9, 13))) for _ in range(150)}
    for s in list(stems):
        k = rng.randrange(len(s))
        stems.add(s[:k] + rng.choice("xyz") + s[k + rng.randint(0, 1) :])
    stems |= {f"x{k:04}samesuffix" for k in range(30)}
    near = lambda a, b: 2 * brute_lcs(a, b) / (len(a) + len(b)) >= 0.86
    one_edit = {(a, b) for a in stems for b in stems if a < b and abs(len(a) - len(b)) <= 1 and near(a, b) and not a.startswith("x0")}
    found = {(r.a, r.b) for r in variants.near_stems(spark.createDataFrame([(s, "f") for s in stems], "stem string, field string"), common=10).collect()}
    assert all(near(a, b) for a, b in found)
    missed = one_edit - found
    assert len(missed) <= 0.02 * len(one_edit), sorted(missed)[:5]


def test_hot_suffixes_lose_no_near_pair(spark):
    """A third of all stems share a suffix; blocks are refined twice, and pairs of them are found all the same."""
    rng = random.Random(9)
    heads = {"".join(rng.choices("abdegiklmoprstuv", k=rng.randint(5, 7))) for _ in range(250)}
    stems = {h + "samesuffix" for h in heads} | {"".join(rng.choices("abdegiklmoprstuv", k=12)) for _ in range(300)}
    for s in sorted(stems):
        k = rng.randrange(7)
        stems.add(s[:k] + rng.choice("xyz") + s[k + rng.randint(0, 1) :])
    near = lambda a, b: 2 * brute_lcs(a, b) / (len(a) + len(b)) >= 0.9
    edits = lambda a, b: len(a) + len(b) - 2 * brute_lcs(a, b)
    ordered = sorted(stems)
    wanted = {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if abs(len(a) - len(b)) <= 1 and (a[-6:] == b[-6:] or a[:4] == b[:4]) and near(a, b) and edits(a, b) <= 2}
    found = {(r.a, r.b) for r in variants.near_stems(spark.createDataFrame([(s, "f") for s in ordered], "stem string, field string"), least=0.9, common=5).collect()}
    assert all(near(a, b) for a, b in found)
    assert len(wanted) > 300 and len(wanted - found) <= 0.02 * len(wanted), (len(wanted), sorted(wanted - found)[:5])


def test_lengths_are_bounded_by_the_ratio_alone(spark):
    a = "abcdefghijklmnopqrstuvwxyzabcdefgh"
    found = variants.near_stems(spark.createDataFrame([(a, "f"), (a + "1234", "f"), (a + "123456789012", "f")], "stem string, field string")).collect()
    assert {(r.a, r.b) for r in found} == {(a, a + "1234"), (a + "1234", a + "123456789012")}


def test_families_by_their_fields(spark):
    given = ["Anna", "Boris", "Celia", *("".join(random.Random(k).choices("bdfgklmn", k=7)).title() for k in range(200))]
    for n in (3, 203):
        rows = [(f"{g} {f}", g, f) for g in given[:n] for f in ("Lindstroem", "Lind")]
        found = variants.parse_people(spark.createDataFrame(rows + [("Lind Boris", "Lind", "Boris")], "spelling string, first string, last string")).collect()
        assert {r.family for r in found} == {"lindstroem", "lind"}, n


def test_names_in_han_script(spark):
    people = [{"name": "李明"}, {"name": "李 明"}, person("明", "李"), {"name": "陳和"}, {"name": "陈和"}, {"name": "陈合"}, {"name": "李明月"}]
    items = spark.createDataFrame([("1", json.dumps(people, ensure_ascii=False), "", "")], ITEMS)
    found = variants.people_variants(items).collect()
    assert {frozenset((r.name_a, r.name_b)) for r in found} == {frozenset(x) for x in (("李明", "李 明"), ("李明", "明 李"), ("李 明", "明 李"), ("陳和", "陈和"))}


def test_organisations_of_other_kinds(spark):
    names = ["St Olga Hospital, Ward 3", "Department of Heat, St. Olga Hosp.", "Olgawerk Company", "OLGAWERK CO", "Zentralwerft, Kiel", "zentralwerft", "Zentralwerfd", "Ulm University", "University of Ulm", "湖畔医院", "湖畔医院 (Lakeside Hospital)", "Lakeside Hospital"]
    cards = spark.createDataFrame([(str(k), n, None, "", "", "") for k, n in enumerate(names)], CARDS)
    linked = {frozenset((r.name_a, r.name_b)) for r in variants.organisation_variants(cards).collect()}
    assert linked >= {frozenset(x) for x in (names[0:2], names[2:4], names[4:6], names[5:7], names[7:9], names[9:11], names[10:12], (names[9], names[11]))}
    assert frozenset((names[0], names[2])) not in linked and frozenset((names[0], names[11])) not in linked


def test_classes_say_the_same_as_pairs(spark):
    people = [person("Robert", "Betubohafu"), person("Bob", "Betubohafu"), person("Victoria", "Betubohafu")]
    items = spark.createDataFrame([("1", json.dumps(people), "", "")] * 3, ITEMS)
    cards = spark.createDataFrame([], CARDS)
    classes = variants.name_classes(cards, items).collect()
    assert {(r.spelling, r.entity, r.n_spellings) for r in classes} == {("Robert Betubohafu", "Bob Betubohafu", 2), ("Bob Betubohafu", "Bob Betubohafu", 2), ("Victoria Betubohafu", "Victoria Betubohafu", 1)}
    assert [(r.name_a, r.name_b) for r in variants.name_variants(cards, items).collect()] == [("Bob Betubohafu", "Robert Betubohafu")]
