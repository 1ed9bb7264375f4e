import json
import os
import time

import pytest
from pyspark.sql import functions as F

from marginalia.functions import scalars as S
from marginalia.operators import mapping, merge, orders
from marginalia.sources import config, files, locks, recognition, sinks
from marginalia.streaming import incremental
from tests.test_core import one


def order_of(df, order, column):
    return [r[column] for r in orders.placed(df, order).orderBy("place").collect()]


def test_orders(spark):
    df = spark.createDataFrame([("b", 2, "10"), ("a", 2, "9"), ("C", 5, "x"), ("d", None, None)], "k string, n int, cell string")
    assert order_of(df, orders.by_weight("n", then=("k",)), "k") == ["C", "a", "b", "d"]
    assert order_of(df, orders.by_name("k", "k"), "k") == ["a", "b", "C", "d"]
    assert order_of(df, orders.as_shown("cell", "k"), "k") == ["a", "b", "d", "C"]
    assert order_of(df, orders.by_number(F.col("cell"), "k"), "k") == ["C", "d", "a", "b"]
    assert order_of(df, orders.newest_first("n", "k"), "k") == ["C", "b", "a", "d"]
    paths = spark.createDataFrame([("b/a",), ("a/b/c",), ("b",), ("a",)], "p string")
    assert order_of(paths, orders.shallow_first("p"), "p") == ["a", "b", "b/a", "a/b/c"]
    assert orders.placed(df.limit(0), orders.by_name("k", "k")).count() == 0


def test_mapped_values(spark, rows):
    assert one(spark, mapping.mapped(F.col("x"), {"a": "b"}, "c"), x="a") == "b"
    assert one(spark, mapping.mapped(F.col("x"), {"a": "b"}, "c"), x=None) == "c"
    assert one(spark, mapping.mapped(F.col("x"), {}, None), x="a") is None
    assert one(spark, mapping.first_containing(F.col("x"), [("near", "n"), ("far", "f")]), x="not far, near") == "n"
    assert one(spark, mapping.first_containing(F.col("x"), [("near", "n")]), x="?") is None
    assert [tuple(t) for t in one(spark, mapping.topic_codes(F.col("x")), x="T2_b c; x; T1_a|T2_d;xT3_e")] == [("T2", "T2_b c"), ("T1", "T1_a")]
    for canonical, gate in (("#p/x", "pass"), ("q", "redirect"), ("", "drop"), (None, "drop")):
        assert one(spark, mapping.gate(F.col("x"), "#p/"), x=canonical) == gate
    df = spark.createDataFrame([("k", "a", " "), ("l", "z", "b"), ("m", None, None)], "key string, f string, g string")
    assert rows(mapping.mapped_with_warnings(df, "key", {"f": {"a": "A"}, "g": {"b": "B"}})) == [("k", ["A"], []), ("l", ["B"], ["f: z"]), ("m", [], [])]
    assert one(spark, S.clean_text("x"), x="热 ok") == "热 ok"


def test_rates_and_means(spark, rows):
    members = spark.createDataFrame([("i", "g"), ("i", "g"), ("j", "g"), ("k", "h")], "item string, grp string")
    hits = spark.createDataFrame([("i",), ("i",), ("i",), ("z",)], "item string")
    assert rows(mapping.hit_rates(members, hits, "item", "grp")) == [("g", 2, 3, 1.5), ("h", 1, 0, 0.0)]
    assert rows(mapping.group_means(members.withColumn("v", F.lit(1) / 3), ["grp"], "v")) == [("g", 3, 0.3333), ("h", 1, 0.3333)]


def test_an_inverse_undoes_its_plan(spark, rows):
    old = spark.createDataFrame([("a", 1, "x"), ("b", None, "y"), ("c", 3, "z")], "k string, v int, w string")
    new = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", None, "z"), ("d", 4, "n")], "k string, v int, w string")
    assert rows(mapping.audit(old, new, "k", ["v"])) == [("b", '{"v":null}', '{"v":2}'), ("c", '{"v":3}', '{"v":null}')]
    undone = merge.upsert(merge.upsert(old, new, ["k"]), mapping.inverse(old, new, "k", ["v", "w"]), ["k"])
    assert rows(undone.where("k <> 'd'")) == rows(old)
    plan = mapping.action_documents(old, "k", "tag", {"v": F.col("v")}, F.col("v").isNotNull())
    assert {json.loads(r.document)["v"] for r in plan.collect()} == {1, 3}
    m = spark.range(1).select(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")).alias("o"), F.create_map(F.lit("b"), F.lit("3")).alias("n"))
    assert m.select(mapping.overlay(F.col("o"), F.col("n"))).first()[0] == {"a": "1", "b": "3"}


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("PLACE", "here")
    text = "﻿a: 1\n# no: x\nb: 'q: r'\nempty:\nc: ${PLACE}/x\ntopics:\n  - code: T1\n    label: \"热\"\n  - code: T2\nlist:\n- one\n- two\nbad line\n"
    assert config.parse_settings(text) == {"a": "1", "b": "q: r", "empty": [], "c": "here/x", "topics": [{"code": "T1", "label": "热"}, {"code": "T2"}], "list": ["one", "two"]}
    assert config.parse_settings("") == {} and config.clean_value(None) == "" and config.clean_value("'") == "'"
    assert config.read_rules(str(tmp_path / "none.json")) == {}
    (tmp_path / "empty.json").write_text("{}")
    (tmp_path / "plan.json").write_text('{"keep": true, "delete": false}')
    assert config.first_found([str(tmp_path / n) for n in ("none.json", "empty.json", "plan.json")], config.read_rules) == {"keep": True, "delete": False}
    assert config.first_found([], config.read_rules) is None
    assert config.read_plan(str(tmp_path / "plan.json"), must=["keep"], must_not=["delete"])["keep"]
    with pytest.raises(PermissionError, match="delete"):
        config.read_plan(str(tmp_path / "plan.json"), must=["delete"])


def test_one_writer_at_a_time(tmp_path):
    lock = str(tmp_path / "lock")
    with locks.writer_lock(lock) as renew:
        renew()
        assert locks.run_once(lock, lambda: None, lambda: None) == 2
        os.utime(lock, (0, 0))
        with open(lock, "w") as f:
            json.dump({"owner": "gone", "renewed": time.time() - 10_000}, f)
        assert locks.run_once(lock, lambda: None, lambda: None) == 0
    assert locks.run_once(lock, lambda: None, lambda: 1 / 0) == 1 and not os.path.exists(lock)


def test_recognition(spark):
    df = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b""))], "path string, content binary")

    def reader(content, dpi, most):
        if not content:
            raise ValueError("empty")
        return ["word " * 40, "two"][:most]

    got = {r.path: r for r in recognition.recognised(df, reader).collect()}
    assert got["a"].status == "ok" and got["a"].pages == 2 and got["a"].text.startswith("===== Page 1 OCR =====")
    assert got["b"].status == "error" and "empty" in got["b"].error


def test_documents_cards_and_seeds(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", None), ("热", 1)], "k string, v int")
    sinks.write_json(df, str(tmp_path / "doc"), {"kind": "t"})
    part = next(p for p in (tmp_path / "doc").iterdir() if p.name.startswith("part-"))
    assert json.loads(part.read_text(encoding="utf-8")) == {"kind": "t", "items": [{"k": "a", "v": None}, {"k": "热", "v": 1}]}
    assert rows(files.read_json_items(spark, str(tmp_path / "doc"), "struct<k:string, v:int>")) == [("a", None), ("热", 1)]
    fields = F.create_map(F.lit("k"), F.lit("v"))
    text = one(spark, files.with_metadata(files.with_metadata(F.col("x"), fields), fields), x="# T\n\nbody")
    assert text == "# T\n\nbody\n\n## Machine metadata\n\n```yaml\nk: v\n```\n"
    front = one(spark, files.with_metadata(files.with_metadata(F.col("x"), fields, "front"), fields, "front"), x="body\n")
    assert front == "---\nk: v\n---\nbody\n"
    assert one(spark, files.card_metadata(files.with_metadata(F.col("x"), fields)), x=None) == {"k": "v"}
    assert rows(files.seeded(spark, ["b", "a", "b"])) == [("a",), ("b",)]
    assert files.given_or(spark, None, "k string", lambda: df).count() == 2


def test_a_first_scan_must_be_asked_for(spark):
    mark = spark.createDataFrame([], "at_time timestamp, k string")
    with pytest.raises(ValueError, match="first scan"):
        incremental.guarded_mark(mark, False)
    assert incremental.guarded_mark(mark, True).isEmpty()
