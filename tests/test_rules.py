"""Rules with defined results for nulls, empty values, ties and clashing names."""

import pytest
from pyspark.sql import functions as F

from lodestack.functions import blocks, text, vector
from lodestack.operators import audit, curriculum, regulations, rewriting, tables
from lodestack.sources import files
from lodestack.streaming import uploads


def test_rewriting_is_logged_and_agrees_with_the_plain_rewriting(spark):
    said = ["đkhp HK1 cho sv k48", "HP CT101 và hp", "(KHHT) khht", "khht (KHHT)", "dang 12/TB-DHCT hk2-hk3, môn học; hoc phan", "", None, "K48sv sv", "mã sv", "học phần", "sv " * 3000]
    at = spark.createDataFrame([(i, t, "kept", 1) for i, t in enumerate(said)], "i int, q string, row string, log int").withColumn("parts", F.lit("own"))
    got = {r.i: r for r in rewriting.audited(at, "q").withColumn("plain", text.normalised_query(F.col("q"))).collect()}
    assert len(got) == len(said) and all(r.normalised == r.plain and r.row == "kept" and r.parts == "own" for r in got.values())
    log = lambda i: [(x.type, x.source, x.target) for x in got[i].rewrites]
    assert log(0) == [("abbreviation", "đkhp", "đăng ký học phần (ĐKHP)"), ("abbreviation", "HK1", "học kỳ 1"), ("abbreviation", "sv", "sinh viên")]
    assert log(1) == [("abbreviation", "HP", "học phần"), ("abbreviation", "hp", "học phần")]
    assert [x[1] for x in log(2)] == ["khht"] and log(3) == [] and log(5) == [] and log(6) == [] and log(9) == []
    assert [x[0] for x in log(4)] == ["abbreviation", "abbreviation", "synonym", "typo"] and [x[1] for x in log(7)] == ["sv"] and len(log(10)) == 3000
    assert rewriting.audited(at.limit(0), "q").count() == 0


def test_lines_as_one(spark):
    pairs = {
        ("đăng-", "ký học"): ("đăngký học", False), ("năm 2025-", "2026 này"): ("năm 2025- 2026 này", False), ("một -", "hai"): ("một - hai", False), ("Cần-", "Thơ"): ("Cần- Thơ", False),
        ("theo 12/QĐ", "-ĐHCT ngày"): ("theo 12/QĐ-ĐHCT ngày", True), ("theo 12/qđ ", " - bgd"): ("theo 12/qđ-bgd", True), ("12/QĐ.", "-ĐHCT"): ("12/QĐ. -ĐHCT", False), (None, "b"): ("b", False), ("a", None): ("a", False), (None, None): ("", False), ("-", "a"): ("- a", False),
    }
    at = spark.createDataFrame([(a, b, *want) for (a, b), want in pairs.items()], "a string, b string, w string, c boolean")
    for r in at.select("*", blocks.continued(F.col("a"), F.col("b")).alias("got"), blocks.split_code(F.col("a"), F.col("b")).alias("code")).collect():
        assert (r.got, r.code) == (r.w, r.c), r


def test_tidy_tables(spark):
    at = spark.createDataFrame([(1, [[" a ", None], None, ["", "  "], ["b\n c", "d"]]), (2, [[" "], []]), (3, []), (4, None)], "i int, rows array<array<string>>")
    assert {r.i: r.t for r in at.select("i", tables.cleaned(F.col("rows")).alias("t")).collect()} == {1: [["a", ""], ["b c", "d"]], 2: None, 3: None, 4: None}


def test_analyses_are_made_safe(spark):
    good = '```{"rewrite": "r", "query_type": "PATH", "entities": [{"type": "Khoa"}, null, {}], "relations": ["co", null], "vector_targets": ["X", "HocPhan"], "ctdt_filters": {"khoa": "K51 2", "he": " "}, "graph_plan": {"expansion_policy": {"max_depth": -3, "max_paths": 1e9, "max_nodes": "x"}}}```'
    at = spark.createDataFrame([(1, good, "q"), (2, None, "q"), (3, "{nothing", None), (4, '{"entities": 5}', "q"), (5, "{}", "q")], "i int, a string, q string")
    got = {r.i: r.x for r in at.select("i", curriculum.analysis(F.col("a"), F.col("q")).alias("x")).collect()}
    one = got[1]
    assert (one.rewrite, one.query_type, one.relations, one.vector_targets, one.cohort, one["mode"]) == ("r", "path", ["CO"], ["HocPhan"], 51, None) and [(e.type, e.value) for e in one.entities] == [("Khoa", "")]
    assert (one.plan.anchors, one.plan.relations, one.plan.max_depth, one.plan.max_nodes, one.plan.shape) == (["Khoa"], ["CO"], 1, 70, "path")
    for i in (2, 3, 4, 5):
        x = got[i]
        assert (x.rewrite, x.query_type, x.entities, x.relations, x.plan.anchors, x.plan.max_depth, x.plan.max_paths, x.plan.shape) == (None if i == 3 else "q", "description", [], [], [], 2, 60, "summary")


def test_vector_hits_as_candidates(spark):
    at = spark.createDataFrame([(1, ["A", "T"], {"id": " 7 ", "embedding": "[]"}, 0.5), (2, [], {"id": "", "ma_hoc_phan": "CT1"}, None), (3, None, None, 1.0), (4, ["A"], {"x": None}, 1.0)], "i int, labels array<string>, props map<string,string>, score double")
    got = {r.i: r.c for r in at.select("i", vector.candidate(F.lit("T"), F.col("labels"), F.col("props"), F.col("score"), F.lit("ix")).alias("c")).collect()}
    assert {i: (c.label, c.node_id, c.score, c.labels, c.props) for i, c in got.items()} == {1: ("T", "7", 0.5, ["A", "T"], {"id": " 7 "}), 2: ("T", "CT1", 0.0, [], {"id": "", "ma_hoc_phan": "CT1"}), 3: ("T", "", 1.0, [], {}), 4: ("A", "", 1.0, ["A"], {"x": None})}


def test_regulations_as_text(spark):
    rows = [(1, 1, None, "1", "article", "first"), (1, 2, None, None, "clause", " "), (1, 3, "CHƯƠNG I", "2", "article", None), (1, 4, "CHƯƠNG I", None, "point", "x" * 50), (1, 5, "CHƯƠNG II", "3", "article", "last"), (2, 1, None, None, "clause", None)]
    at = spark.createDataFrame(rows, "doc_id int, pos int, chapter string, article string, level string, text string")
    whole = "Điều 1 first CHƯƠNG I Điều 2 " + "x" * 50 + " CHƯƠNG II Điều 3 last"
    for most in (1000, 30, 5, len(whole)):
        got = {r.doc_id: (r.n_chars, r.n_sections, r.preview) for r in regulations.plain_text(at, most=most).collect()}
        assert got == {1: (len(whole), 3, whole[:most]), 2: (0, 0, "")}
    named = spark.createDataFrame([('Ban hành kèm theo Quyết định này "Quy chế A"',), ("Ban hành kèm theo Quyết định này Quy chế B",), ("Khác",), (None,)], "t string").select(regulations.regulation_name(F.col("t")).alias("n")).collect()
    assert [r.n for r in named] == ["Quy chế A", "Quy chế B", "Khác", "Văn bản quy chế"]


def test_names_items_and_uploads(spark, tmp_path):
    names = {"/a/b_document.json": "b_hierarchy.json", "b_DOCUMENT(12).json": "b_hierarchy.json", "s3://x/b.v2_document(1)_x.json": "b.v2_document(1)_x_hierarchy.json", "": "_hierarchy.json"}
    at = spark.createDataFrame([(k, v) for k, v in names.items()], "p string, w string").select("w", files.stage_name(F.col("p"), "document", "hierarchy").alias("n"))
    assert all(r.n == r.w for r in at.collect())
    items = spark.createDataFrame([([("a", "metadata"), ("b", None), ("c", "x")],), (None,)], "items array<struct<t:string,dang:string>>").select(files.without_metadata(F.col("items")).alias("i")).collect()
    assert [x.t for x in items[0].i] == ["b", "c"] and items[1].i is None
    good = uploads.CATEGORIES[0]
    asked = [("a.PDF", good, 1, None), ("", "x", 0, "name missing"), (None, good, 0, "name missing"), ("a.pdf", None, 0, "unknown category"), ("a.pdf.doc", good, 0, "no pdf"), ("a.pdf", good, uploads.MOST_BYTES + 1, "too large"), ("a.pdf", good, uploads.MOST_BYTES, None), ("a.pdf", good, None, None)]
    at = spark.createDataFrame(asked, "n string, c string, s long, w string")
    assert all(r.w == r.got for r in at.select("w", uploads.refused(F.col("n"), F.col("c"), F.col("s")).alias("got")).collect())
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a b.pdf").write_bytes(b"12345")
    assert [(r.name, r.size) for r in uploads.listed(spark, str(tmp_path / "in")).collect()] == [("a b.pdf", 5)]
    counts = audit.item_counts(spark.createDataFrame([(1, "text"), (1, None), (1, "table"), (2, "x")], "d int, item string"), "d").collect()
    assert sorted(map(tuple, counts)) == [(1, 1, 1, 1), (2, 0, 0, 1)]


def test_json_sink_and_migration(spark, tmp_path):
    rows = spark.createDataFrame([("f1", "đăng ký", None), ("f2", None, {"old": "1", "new": "2"})], "file string, t string, props map<string,string>")
    for _ in range(2):  # a second run replaces the first
        files.write_json(rows, str(tmp_path / "out"), by="file")
    back = {r.file: r for r in spark.read.schema("t string, props map<string,string>, file string").json(str(tmp_path / "out")).collect()}
    assert (back["f1"].t, back["f1"].props, back["f2"].t, back["f2"].props) == ("đăng ký", None, None, {"old": "1", "new": "2"})
    raw = next((tmp_path / "out" / "file=f1").glob("*.json")).read_text("utf-8")
    assert raw == '{"t":"đăng ký","props":null}\n'
    assert files.migrated(rows, ("t", "gone")).columns == ["file", "props"]
    assert [r.props for r in files.migrated(rows, ("old", "x"), "props").collect()] == [None, {"new": "2"}]
    docs = spark.createDataFrame([(None, "f", 3)], "ma_van_ban string, ten_file string, tieu_de int").withColumn("ngay_ban_hanh", F.lit(None).cast("date"))
    assert [tuple(r) for r in files.metadata(docs).collect()] == [("", "f", "3", "")]


@pytest.mark.parametrize("issued,warning", [("2024", "ngày ban hành chỉ có năm"), ("2024-05", "ngày ban hành chỉ có tháng và năm"), ("", "không trích được ngày ban hành"), (None, "không trích được ngày ban hành"), ("2024-05-06", None)])
def test_extraction_warnings(spark, issued, warning):
    at = spark.createDataFrame([(1, "c", issued, "t", 2)], "id int, code string, issued string, title string, pages int")
    assert audit.extraction_warnings(at).first().warnings == ([warning] if warning else [])
