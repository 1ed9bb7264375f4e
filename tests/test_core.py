import datetime
import hashlib
import json
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.functions import paragraphs, scalars as S
from marginalia.functions.affiliations import Rules, affiliation_of
from marginalia.operators import aggregate, merge, paths, rules, search, sets
from marginalia.plans import round_trips
from marginalia.sources import files, sinks
from marginalia.sources.paged import PagedSource
from marginalia.streaming import incremental

T = datetime.datetime(2024, 1, 1)


def one(spark, column, **cells):
    schema = ", ".join(f"{k} string" for k in cells)
    return spark.createDataFrame([tuple(cells.values())], schema).select(column).first()[0]


SCALARS = [
    (lambda: S.item_key("x"), "zot://select/library/items/abCD1234", "ABCD1234"),
    (lambda: S.item_key("x"), "[ABCD1234](lib://select/library/items/ABCD1234)", "ABCD1234"),
    (lambda: S.item_key("x"), " 'ABCD1234' ", "ABCD1234"),
    (lambda: S.item_key("x"), "abcd", ""),
    (lambda: S.item_key("x"), None, ""),
    (lambda: S.attachment_key("x"), "PDF attachment key: ABCD1234", "ABCD1234"),
    (lambda: S.attachment_key("x"), "?", ""),
    (lambda: S.year_of("x"), "2019/05/01", "2019"),
    (lambda: S.year_of("x"), "May-2003", "2003"),
    (lambda: S.year_of("x"), "2023年6月", "2023"),
    (lambda: S.year_of("x"), "c. 2001", ""),
    (lambda: S.slug("x"), "  Heat & Mass! ", "heat-mass"),
    (lambda: S.slug("x"), "热舒适", "unclassified"),
    (lambda: S.compact_token("x"), "Top-Floor 3", "topfloor3"),
    (lambda: S.display_width("x"), "ab热", 4),
    (lambda: S.tag_namespace("x"), "#topic/a/b", "topic"),
    (lambda: S.tag_value("x"), "#topic/a/b", "a/b"),
    (lambda: S.compact_whitespace("x"), " a \t b\r\n\r\n\r\n\r\nc ", "a b\n\nc"),
    (lambda: S.compact_text("x", 5), "abcdefg", "abcde"),
    (lambda: S.first_page("x", 100), "pre\n===== Page 1 =====\n one \n===== Page 2 =====\ntwo", "one"),
    (lambda: S.first_page("x", 100), "no pages", "no pages"),
    (lambda: S.first_pages("x", 1), "===== Page 1 =====\none\n===== Page 2 =====\ntwo", "===== Page 1 =====\none"),
    (lambda: S.first_pages("x", 1), "===== Page 7 =====\nseven", ""),
    (lambda: S.html_escape("x"), "<a & \"b\">", "&lt;a &amp; &quot;b&quot;&gt;"),
    (lambda: S.markdown_escape("x"), "a|b\nc", "a\\|b c"),
    (lambda: S.portable_path("x", "corpus"), "C:\\w\\corpus\\a.md", "corpus/a.md"),
    (lambda: S.clean_rank("x"), " ；SCI ; 1区, ", "SCI、1区"),
    (lambda: S.citation_label("x", F.lit("2020")), "Ann Lee; Bo Ek", "Lee(2020)"),
    (lambda: S.citation_label("x", F.lit("")), "", "Unknown(n.d.)"),
    (lambda: S.compact_authors("x", F.lit("Ek")), "Lee; Oh; Ek", "Lee; Ek"),
    (lambda: S.creators_text("x"), '[{"name": " Org "}, {"firstName": "A", "lastName": "B"}, {"firstName": null, "lastName": "C"}]', "Org; A B; C"),
    (lambda: S.creators_text("x"), "no list", ""),
    (lambda: S.rank_text(S.rank_map("x"), ["sci", "xr"]), "XR: 2; sci: Q1; sci: Q2; bad; none: ?", "sci: Q2; xr: 2"),
]


@pytest.mark.parametrize("k", range(len(SCALARS)))
def test_scalars(spark, k):
    column, cell, expected = SCALARS[k]
    assert one(spark, column(), x=cell) == expected


def test_lists(spark):
    assert one(spark, S.split_list("x", ";,|"), x=" a; b,,c|") == ["a", "b", "c"]
    assert one(spark, S.inline_list("x"), x='[A, "B"]') == ["A", "B"]
    assert one(spark, S.inline_list("x"), x="A/b") == ["a", "b"]
    assert one(spark, S.normalize_tags(S.known_strings("x"), "ns/", 2), x='["#a", "ns/a", "b", "c"]') == ["ns/a", "ns/b"]
    assert one(spark, S.known_strings("x"), x="[1") == []


def test_paragraphs(spark):
    text = "A long sen-\ntence goes\non.\n\n===== Page 2 =====\n- item  one\n温度\n升高，\n(see\nbelow )"
    assert one(spark, paragraphs.reflow_text("x"), x=text) == "A long sentence goes on.\n\n===== Page 2 =====\n\n- item one\n\n温度升高， (see below )\n"
    assert one(spark, paragraphs.reflow_text("x"), x=None) == ""
    assert one(spark, paragraphs.section_map("x"), x="# 1. First\na\n?\nb\n<h2>Second</h2>\nc") == {"First": "a b", "Second": "c"}
    assert one(spark, paragraphs.repair_encoding("x"), x="热舒适".encode().decode("gbk", "ignore")) in ("热舒适", "热舒适".encode().decode("gbk", "ignore"))


def test_sections_merge_and_drop(spark):
    text = "before\n## 2.1 方法\n- a\n\n### \u2728 方法\nb\n# 12\nlost? no\n<h3 id='x'><b>Last</b></h3>\n?"
    assert one(spark, paragraphs.section_map("x"), x=text) == {"方法": "- a b", "12": "lost? no", "Last": ""}
    for cell in (None, "", "no heading", "\u0001\u0002"):
        assert one(spark, paragraphs.section_map("x"), x=cell) == {}
    assert one(spark, paragraphs.reflow_text("x"), x="\u0001a\u0002\r\nb") == "a b\n"
    assert one(spark, paragraphs.reflow_text("x"), x="(1) one\nb) two\nthree\n热\n舒\n适") == "(1) one\n\nb) two\n\nthree 热舒适\n"


AFFILIATIONS = [
    ("Title of a text\nAnn Lee, Bo Ek\na Department of Heat, Lakeside University, Tan 1\n100084 Lake, China b School of Air, Other\nAbstract\nA university", "Department of Heat, Lakeside University, Tan 1, 100084 Lake, China"),
    ("received 1999, University\n¹ 湖畔大学建筑系，\n摘要 研究所", "湖畔大学建筑系，"),
    ("Institutes\nSchoolhouse", ""),
    ("x\n" * 130 + "University", ""),
    ("Institute " + "y" * 400, "Institute " + "y" * 290),
    (None, ""),
    ("", ""),
]


@pytest.mark.parametrize("text, expected", AFFILIATIONS)
def test_first_affiliation(spark, text, expected):
    assert one(spark, affiliation_of("x"), x=text) == expected


def test_affiliation_rules_are_the_callers(spark):
    rules = Rules(places=("werft",), others=(), follow=0)
    assert one(spark, affiliation_of("x", rules), x="University\n1) Werft Nord,\nWerft Süd") == "Werft Nord"


def test_sets(spark):
    row = spark.range(1).select(F.array(*map(F.lit, "abab")).alias("a"), F.array(*map(F.lit, "bc")).alias("b"))
    got = row.select(sets.union_keep_order(F.col("a"), F.col("b")), sets.append_missing(F.col("a"), F.col("b")), sets.remove(F.col("a"), F.col("b")), sets.missing(F.col("b"), F.col("a"))).first()
    assert list(got) == [["a", "b", "c"], ["a", "b", "a", "b", "c"], ["a", "a"], ["c"]]


def test_upsert_is_idempotent_and_keeps_first_sight(spark, rows):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, first string")
    new = spark.createDataFrame([("b", 2, "z"), ("c", None, "w")], "k string, v int, first string")
    once = merge.upsert(old, new, ["k"], ["first"])
    assert rows(once) == [("a", 1, "x"), ("b", 2, "y"), ("c", None, "w")]
    assert rows(merge.upsert(once, new, ["k"], ["first"])) == rows(once)
    assert rows(merge.change_events(old, new, "k", ["v"])) == [("b", "updated_item"), ("c", "new_item")]


def test_last_rows_and_numbering(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, None)], "k string, t int, v string")
    assert rows(merge.last_rows(df, ["k"], ["t"])) == [("a", 2, "z"), ("b", None, None)]
    numbered = merge.numbered(spark.range(1000).withColumn("s", F.sha2(F.col("id").cast("string"), 256)), "n", [F.col("s")])
    got = [r.n for r in numbered.orderBy("s").collect()]
    assert got == list(range(1, 1001))


def test_merge_known(spark, rows):
    old = spark.createDataFrame([("K1", "a", "?"), ("K2", "b", "c"), (None, "d", "e")], "k string, x string, y string")
    new = spark.createDataFrame([("k1", "?", "n"), ("K3", None, "m"), ("k1", "q", None)], "k string, x string, y string")
    assert rows(merge.merge_known(old, new, "k")) == [("K2", "b", "c"), ("K3", "", "m"), ("k1", "a", "n"), ("k1", "q", "")]
    assert rows(merge.fill_unknown(new, old.withColumn("k", F.lower("k")), "k", ["x"])) == [("K3", None, "m"), ("k1", "a", "n"), ("k1", "q", None)]


def test_stale_runs(spark):
    df = spark.createDataFrame([("r", "running", T, None, None, ""), ("s", "running", T, T + datetime.timedelta(hours=9), None, "x"), ("t", "finished", T, T, T, "")], "id string, status string, started_at timestamp, heartbeat_at timestamp, finished_at timestamp, note string")
    now = F.lit("2024-01-01 09:30:00").cast("timestamp")
    got = {r.id: (r.status, r.note) for r in merge.stale_runs(df, now, 3600, "lost").collect()}
    assert got == {"r": ("interrupted", "lost"), "s": ("running", "x"), "t": ("finished", "")}


def test_aggregates(spark, rows):
    links = spark.createDataFrame([("i1", "a"), ("i1", "b"), ("i1", "a"), ("i2", "a"), ("i2", "b"), ("i3", "c")], "m string, g string")
    assert rows(aggregate.pair_overlap(links, "m", "g")) == [("a", "b", 2, 2, 2, 1.0)]
    counts = spark.createDataFrame([("g", "x", 1), ("g", "y", 1), ("h", "x", 5)], "g string, v string, n int")
    assert {r.g: round(r.entropy, 9) for r in aggregate.normalized_entropy(counts, ["g"], "n").collect()} == {"g": 1.0, "h": 0.0}
    assert rows(aggregate.top_per_group(counts, ["g"], "v", "n", 1)) == [("g", "x (1)"), ("h", "x (5)")]


def test_rules_topics_and_paths(spark, rows):
    df = spark.createDataFrame([("a", "Radiant floor in a School"), ("b", None)], "k string, t string")
    assert rows(rules.rule_hits(df, "k", S.text_blob("t"), [("g", "n", ["zzz", "School"]), ("g", "m", ["none"])])) == [("a", "g", "n", "School")]
    assert rows(rules.topics_of(df, "k", S.split_list("t", ";"), [("T1", "radiant"), ("T2", "x-ray")])) == [("a", "T1"), ("b", "UNCLASSIFIED")]
    wanted, held = spark.createDataFrame([("a/b/c",), ("a",)], "path string"), spark.createDataFrame([("a",)], "path string")
    assert rows(paths.missing_prefixes(wanted, held)) == [("a/b", 1), ("a/b/c", 2)]
    links = spark.createDataFrame([("r", None, "R"), ("c", "r", "C"), ("o", "gone", "O"), ("x", "y", "X"), ("y", "x", "Y")], "node string, parent string, name string")
    assert dict(rows(paths.walk_up(links))) == {"r": "R", "c": "R/C", "o": "gone/O", "x": "Y/X", "y": "X/Y"}


def test_search_is_literal(spark, rows):
    df = spark.createDataFrame([("a", "100% sure", 0), ("b", "100x sure", None), ("c", "100% gone", 1)], "item_key string, title string, zotero_deleted int")
    assert rows(search.search(df, "100%", ["title"]), "item_key") == [("a",)]


def test_files(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('\ufeffk,v\n1,"x, ""y"""\n2,\n', encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), ["k", "v", "w"], ["k"])
    assert rows(df) == [("1", 'x, "y"', ""), ("2", "", "")]
    with pytest.raises(ValueError, match="missing columns: z"):
        files.read_csv(spark, str(tmp_path / "a.csv"), required=["z"])
    (tmp_path / "a.jsonl").write_text('{"k": "1"}\nbad\n{"k": "2"}\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k string", strict=False).count() == 2
    (tmp_path / "items.json").write_text(json.dumps({"items": [{"k": "1"}, {"k": "2"}]}))
    assert rows(files.read_json_items(spark, str(tmp_path / "items.json"), "struct<k:string>")) == [("1",), ("2",)]
    cards = tmp_path / "cards"
    cards.mkdir()
    (cards / "one.md").write_text("---\ntitle: 'Front'\n---\nbody\n\n## Machine metadata\n\n```yaml\ntitle: Tail\nkey: K1\n# no: line\nkey: K2\n```\n")
    (cards / "_skip.md").write_text("x")
    texts = files.read_texts(spark, str(cards))
    assert texts.select(files.card_metadata(F.col("text"))).first()[0] == {"key": "K2", "title": "Front"}
    table = "| Key | A | B |\n| --- | --- | --- |\n| [ABCD1234](x://items/ABCD1234) | one | two |\n| [ABCD1234](x://items/ZZZZ9999) | no | no |"
    assert [tuple(x) for x in one(spark, files.markdown_table(F.col("x"), ["a", "b"]), x=table)] == [("ABCD1234", "one", "two")]


def test_materials(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("热舒适".encode("gb18030"))
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/></w:document>')
    (tmp_path / "c.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_materials(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "热舒适" and got["b.docx"].text == "one\ttwo"
    assert got["c.docx"].status == "error" and got["c.docx"].error


RECORDS = [{"key": f"K{k}", "version": k} for k in range(25)]


def fetch_page(start, limit):
    return RECORDS[start : start + limit]


def test_paged_source(spark):
    spark.dataSource.register(PagedSource)
    reader = lambda **o: spark.read.format("paged").options(fetcher="tests.test_core:fetch_page", page_size=10, **o).load()
    assert reader().count() == 25
    assert reader(total=25).select("key").distinct().count() == 25
    assert reader(max_records=12).count() == 12
    assert reader(total=25).rdd.getNumPartitions() == 3


def test_paged_items_of_folder(spark, tmp_path, rows):
    kept = [(f"K{k}", k, f"title {k}") for k in range(250)] + [(None, 7, "no key"), ("K1", None, None), ("K2", 2, "title 2")]
    table = tmp_path / "library_items.parquet"
    spark.createDataFrame(kept, "item_key string, version int, title string").repartition(7).write.parquet(str(table))
    (table / "_notes").write_text("no part of the table")
    expected = Counter((key, version, hashlib.md5((title or "").encode()).hexdigest()) for key, version, title in kept)
    for base in (str(tmp_path), tmp_path.as_uri()):
        assert {(r.key, r.version, r.title): r.n for r in round_trips.paged_items(spark, base).collect()} == expected


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([("i1", "a1", "text"), ("i2", "a2", ""), ("i3", "a3", "more")], "item_key string, attachment_key string, text string")
    first = dict(rows(sinks.write_texts(df, str(tmp_path / "cache"))))
    assert first == {"exported": 2, "skipped": 1}
    assert dict(rows(sinks.write_texts(df, str(tmp_path / "cache")))) == {"linked_existing": 2, "skipped": 1}
    sinks.write_csv(df, str(tmp_path / "csv"), ["item_key", "none"])
    assert rows(files.read_csv(spark, str(tmp_path / "csv"), ["item_key", "none"])) == [("i1", ""), ("i2", ""), ("i3", "")]
    sinks.append_events(df.select("item_key"), str(tmp_path / "log"), {"status": "new"})
    sinks.append_events(df.select("item_key"), str(tmp_path / "log"), {"status": "new"})
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    sinks.write_by_topic(df, spark.createDataFrame([("i1", "T1"), ("i1", "T2")], "item_key string, topic string"), "item_key", str(tmp_path / "topics"))
    assert spark.read.parquet(str(tmp_path / "topics")).count() == 2
    assert sinks.markdown_report(df.limit(1)).splitlines()[0] == "| item_key | attachment_key | text |"
    assert "<td>more</td>" in sinks.html_report(df, "t")
    assert one(spark, sinks.packet(F.col("x"), {"a": F.lit("b")}, F.lit("c")), x="T") == "## T\n\n- a: b\n\nc\n"


def test_watermark(spark, rows):
    df = spark.createDataFrame([("a", T), ("b", T), ("c", T + datetime.timedelta(1)), ("d", None)], "k string, t timestamp")
    mark = incremental.watermark(df.where("k = 'a'"), "t", "k")
    assert rows(incremental.newer_than(df, mark, "t", "k"), "k") == [("b",), ("c",)]
    assert rows(incremental.newer_than(df, mark.limit(0), "t", "k"), "k") == [("a",), ("b",), ("c",)]


def test_streams(spark, tmp_path, rows):
    schema = "k string, v int, t timestamp"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, T), ("b", 1, T), ("a", 2, T + datetime.timedelta(1))], schema).coalesce(1).write.parquet(source)
    table, point = str(tmp_path / "table"), str(tmp_path / "point")

    def run():
        incremental.upsert_stream(incremental.read_events(spark, source, schema), table, point, ["k"], ["t"]).awaitTermination(120)

    run()
    spark.createDataFrame([("b", 5, T + datetime.timedelta(2)), ("c", 1, T)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert rows(incremental.read_versioned(spark, table, 1 << 30), "k", "v") == [("a", 2), ("b", 5), ("c", 1)]
    seen = []
    stream = incremental.read_events(spark, source, schema)
    incremental.emit_once(stream, "k", "t", "10 days", lambda df, n: seen.extend(r.k for r in df.collect()), str(tmp_path / "point2")).awaitTermination(120)
    assert sorted(seen) == ["a", "b", "c"]


def test_cut_lineage_lies_in_the_shared_folder(spark, rows):
    from marginalia.session import cut_lineage, own_folder, shared_folder

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.createDataFrame([("a", None, [1, None]), (None, 2.5, [])], "k string, v double, l array<int>")
    cut = cut_lineage(df)
    assert rows(cut) == rows(df) and cut.schema == df.schema
    assert all(f.startswith(own_folder(spark)) for f in cut.inputFiles())
    assert cut_lineage(df.limit(0)).count() == 0
