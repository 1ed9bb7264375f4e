import pytest

from marginalia.operators.packed import packed_values, unpack

CASES = [
    ("tags", 'a; "b; c"; d', ["a", "b; c", "d"]),
    ("tags", '["x", "y, z"]', ["x", "y, z"]),
    ("tags", "['x', 'y']", ["x", "y"]),
    ("tags", "a;; b ;; a;", ["a", "b", "a"]),
    ("tags", "topic/one / two|three、four\tfive\nsix，seven", ["topic/one", "two", "three", "four", "five", "six", "seven"]),
    ("tags", 'open " quote; b', ['open " quote', "b"]),
    ("tags", "[]", []),
    ("tags", " ;;, ", []),
    ("names", "Last, First", ["Last, First"]),
    ("names", "Last, F.; Other, G.", ["Last, F.", "Other, G."]),
    ("names", "Ann Lee, Bo Ek and Cy Oh", ["Ann Lee", "Bo Ek", "Cy Oh"]),
    ("names", "Ann Lee, Bo Ek, et al.", ["Ann Lee", "Bo Ek"]),
    ("names", "Lee, Ann and Ek, Bo", ["Lee, Ann", "Ek, Bo"]),
    ("names", "Ann Lee & Bo Ek", ["Ann Lee", "Bo Ek"]),
    ("names", '"Lee, Ann", "林和", "Ek, Bo"', ["Lee, Ann", "林和", "Ek, Bo"]),
    ("names", "林和 陈知若 邱远", ["林和", "陈知若", "邱远"]),
    ("names", "林和,陈知/邱远、温书 等", ["林和", "陈知", "邱远", "温书"]),
    ("addresses", "a Dept, X Univ, City 123, Italy b School, Y Univ, USA", ["Dept, X Univ, City 123, Italy", "School, Y Univ, USA"]),
    ("addresses", "¹One, A ²Two, B", ["One, A", "Two, B"]),
    ("addresses", "(1) One, A (2) Two, B", ["One, A", "Two, B"]),
    ("addresses", "1. One, A\n2. Two, B", ["One, A", "Two, B"]),
    ("addresses", '"One; A"; "Two, B"', ["One; A", "Two, B"]),
    ("addresses", "One, A / Two, B | Three, C；Four, D;", ["One, A", "Two, B", "Three, C", "Four, D"]),
    ("addresses", "* One, A", ["One, A"]),
]


@pytest.mark.parametrize("kind", ["tags", "names", "addresses"])
def test_values(spark, kind):
    cases = [(cell, values) for k, cell, values in CASES if k == kind]
    df = unpack(spark.createDataFrame([(str(i), cell) for i, (cell, _) in enumerate(cases)] * 2, "id string, cell string"), kind)
    found = {}
    for r in df.orderBy("id", "pos").collect():
        found.setdefault(r.id, []).append((r.pos, r.value, r.n))
    for i, (cell, values) in enumerate(cases):
        assert found.get(str(i), []) == [(p, v, len(values)) for p, v in enumerate(values, 1)], cell


def test_nulls_long_cells_and_no_rows(spark):
    many = "; ".join(f"v{k}" for k in range(5000))
    df = unpack(spark.createDataFrame([("a", None), (None, "x; y"), ("b", "?"), ("c", "未填写"), ("d", many)], "id string, cell string"), "tags")
    assert sorted((r.id or "", r.pos) for r in df.where("id IS NULL OR id <> 'd'").collect()) == [("", 1), ("", 2)]
    assert df.where("id = 'd'").count() == 5000
    assert unpack(spark.createDataFrame([], "id string, cell string"), "names").count() == 0


def test_tables_with_other_columns(spark):
    affiliations = spark.createDataFrame([("c1", "One, A; Two, B", 1, "x")], "card_id string, first_author_affiliation_raw string, pos int, value string")
    summary = spark.createDataFrame([("c1", "a; b", "Ann Lee", "z"), ("c1", "a; b", "Ann Lee", "z")], "`人工参阅编号` string, Tags string, `作者` string, cell string")
    found = sorted((r.field, r.card_id, r.pos, r.value) for r in packed_values(affiliations, summary).collect())
    assert found == [
        ("Tags", "c1", 1, "a"), ("Tags", "c1", 2, "b"), ("first_author_affiliation_raw", "c1", 1, "One, A"), ("first_author_affiliation_raw", "c1", 2, "Two, B"), ("作者", "c1", 1, "Ann Lee"),
    ]
