"""Operators on hand-made fixtures and properties."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import docs, evaluate, graph, ingest, rank, scope, tables
from lodestack.sources import files
from lodestack.streaming import uploads


def test_rerank_fixture(spark):
    rows = [("a1", "X", 2024, 0.9), ("b1", "Y", 2023, 0.8), ("a2", "X", 2025, 0.7), ("u1", " ", None, 0.6), ("b2", "Y", 2025, 0.5)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, type string, year int, score double, seq int")
    got = {r.id: r.position for r in rank.reranked(df, F.struct(F.coalesce("year", F.lit(0)))).collect()}
    assert got == {"a1": 3, "b1": 5, "a2": 1, "u1": 4, "b2": 2}
    with pytest.raises(ValueError):
        rank.reranked(df, F.lit(1), 0)


def test_rerank_is_a_permutation_that_keeps_places(spark):
    rng = random.Random(4)
    rows = [(f"n{i}", rng.choice(["X", "Y", "", None]), rng.randint(2020, 2023), rng.choice([0.1, 0.5, 0.9]), i) for i in range(80)]
    df = spark.createDataFrame(rows, "id string, type string, year int, score double, seq int")
    got = {r.id: r.position for r in rank.reranked(df, F.struct("year")).collect()}
    place = {r[0]: p for p, r in enumerate(sorted(rows, key=lambda r: (-r[3], r[4])), 1)}
    assert sorted(got.values()) == list(range(1, 81))
    for kind in ("X", "Y"):
        of = [r for r in rows if r[1] == kind]
        assert sorted(got[r[0]] for r in of) == sorted(place[r[0]] for r in of)
        newest = sorted(of, key=lambda r: r[0])
        newest.sort(key=lambda r: (r[2], r[3]), reverse=True)
        assert [r[0] for r in sorted(of, key=lambda r: got[r[0]])] == [r[0] for r in newest]
    assert all(got[r[0]] == place[r[0]] for r in rows if not r[1])


def test_merge_and_pin(spark):
    df = spark.createDataFrame([("d", "n1", "vector", 0.9, 0), ("d", "n1", "exact", 0.2, 1), ("d", "n2", "vector", 0.5, 2), ("d", "n2", "vector", 0.7, 3), ("d", "n3", "vector", None, 4)], "domain string, id string, source string, score double, seq int")
    merged = rank.merged(df)
    assert {(r.id, r.source, r.score) for r in merged.collect()} == {("n1", "exact", 0.2), ("n2", "vector", 0.7), ("n3", "vector", 0.0)}
    assert [r.id for r in rank.pinned(merged, 1).collect()] == ["n1"]
    with pytest.raises(ValueError):
        rank.pinned(merged, 0)


def test_exact_cells(spark):
    rows = [
        (1, ["Mã HP", "Khóa"], ["CT219", "K50"]), (2, ["Mã HP", "Khóa"], ["ct219", "50"]), (3, ["Mã HP", "Khóa"], ["CT219", "K51"]), (4, ["Mã HP"], ["CT219"]), (5, ["Nội dung"], ["CT219"]),
        (6, ["Mã HP", "Khóa"], ["CT219"]), (7, None, None), (8, ["Ngành"], ["Khoa học Máy tính"]),
    ]
    df = spark.createDataFrame(rows, "id int, headers array<string>, cells array<string>")
    ids = lambda wanted: {r.id for r in tables.matching_rows(df, wanted).collect()}
    assert ids({"course": "CT219"}) == {1, 2, 3, 4, 6} and ids({"course": "CT219", "cohort": "K50"}) == {1, 2, 4} and ids({"cohort": "K50"}) == {1, 2} and ids({"major": "khoa hoc may tinh"}) == {8}


def test_forward_fill(spark):
    rows = [["1", "K50", "a"], ["", "", "b"], ["2", "", ""], ["", "K51"], ["3"]]
    df = spark.createDataFrame([("t", i, ["TT", "Khoa", "X"], r) for i, r in enumerate(rows)] + [("u", 0, [], ["x"])], "t string, i int, headers array<string>, cells array<string>")
    once = tables.forward_filled(df, ["t"], ["i"])
    got = [r.cells for r in once.where("t = 't'").orderBy("i").collect()]
    assert got == [["1", "K50", "a"], ["", "K50", "b"], ["2", "K50", "b"], ["", "K51", "b"], ["3", "K51", "b"]]
    assert sorted(tables.forward_filled(once, ["t"], ["i"]).collect()) == sorted(once.collect()) and once.where("t = 'u'").first().cells == []


def test_names_and_texts(spark):
    df = spark.createDataFrame([(["A", "", "A", None, "a"], ["x", "", "y", "z"], ["T", "t ", "", "u", "U", "T"])], "n array<string>, v array<string>, p array<string>")
    r = df.select(tables.unique_names(F.col("n")).alias("n"), tables.row_text(F.col("n"), F.col("v")).alias("t"), tables.joined_parts(F.col("p")).alias("p"), tables.fitted_row(F.col("v"), F.lit(5)).alias("w")).first()
    assert r.n == ["A", "cot_2", "A_2", "cot_4", "a"] and r.t == "A: x\nA: y" and r.p == "T\n\nu\n\nT" and r.w == ["x", "", "y", "z", ""]


EDGES = [("p", "b1", "CO"), ("b1", "h1", "GOM"), ("b1", "h2", "GOM"), ("h1", "h3", "YEU_CAU")]


def test_graph(spark):
    edges = spark.createDataFrame(EDGES + [("h3", "p", "BACK")], "src string, dst string, type string")
    tree = spark.createDataFrame(EDGES, "src string, dst string, type string")
    p = spark.createDataFrame([("p",)], "id string")
    assert {(r.id, r.depth) for r in graph.descent(edges, p, 9).collect()} == {("p", 0), ("b1", 1), ("h1", 2), ("h2", 2), ("h3", 3)}  # the cycle ends
    assert all(len(r.path) == r.depth + 1 for r in graph.descent(edges, p, 9).collect())
    assert {r.id for r in graph.within(tree, p, 2).collect()} == {"p", "b1", "h1", "h2"}
    two = spark.createDataFrame([("h2",), ("alone",)], "id string")
    assert {"-".join(r.nodes) for r in graph.expanded(tree, two, 2).collect()} == {"h2-b1", "h2-b1-p", "h2-b1-h1", "alone"}
    assert {"-".join(r.nodes) for r in graph.expanded(tree, two, 2, ["CO"]).collect()} == {"h2-b1-p", "alone"}
    assert {"-".join(r.nodes) for r in graph.expanded(tree, two, 2, ["NONE"]).collect()} == {"h2-b1", "h2-b1-p", "h2-b1-h1", "alone"}
    capped = graph.capped(graph.expanded(tree, two, 2), [F.col("depth"), F.array_join("nodes", "-")], 3, 2)
    assert {r.id for r in capped.collect()} == {"alone", "h2"}


def test_evaluation(spark):
    rows = [(["GOLD", "o"], None, [["GOLD"]], None, "g"), (list("ABCDE") + ["GOLD"], [], [["GOLD"]], 1, "g"), (["anchor"], ["GOLD"], [["GOLD"]], 1, "g"), (["anchor"], ["rel"], [["GOLD"]], 0, "h"), (["A"], ["B"], [["A", "A2"], ["B"]], 1, "h"), (["A"], [], [["A"], ["B"]], 0, "h")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, selected array<string>, expanded array<string>, groups array<array<string>>, accurate int, `group` string")
    got = [(r.direct_hit, r.final_hit, r.recovered) for r in evaluate.scored(df, 6).orderBy("id").collect()]
    assert got == [(1, 1, 0), (1, 1, 0), (0, 1, 1), (0, 0, 0), (0, 1, 1), (0, 0, 0)]
    total = {r.group: r for r in evaluate.summary(evaluate.scored(df, 6)).collect()}["Overall"]
    assert (total.n, total.missed, total.recovered, total.recovery_rate, total.accuracy) == (6, 4, 2, 50.0, 60.0)
    with pytest.raises(Exception, match="final hit"):
        spark.createDataFrame([(1, 0)], "a int, b int").select(evaluate.recovered(F.col("a"), F.col("b"))).collect()
    classes = spark.createDataFrame([(1, None), (1, 1), (0, 1), (0, 0), (1, 0)], "f int, a int").select(evaluate.error_class(F.col("f"), F.col("a")).alias("c")).collect()
    assert [r.c for r in classes] == ["UNGRADED", "OK", "GOLD_AUDIT", "EVIDENCE_MISS", "GENERATION"]


def test_section_trees(spark):
    text = ["before", "1. One", "body", "1.1 Sub", "1.2 Sub", "x", "y", "2. Two", "2.1.1 Deep", "1. One again"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)] + [("e", 0, "1.1 first")], "doc string, pos int, line string")
    got = {(r.doc, r.id): (r.parent_id, r.level, r.text) for r in docs.section_trees(df, "doc", "pos").collect()}
    assert got == {
        ("d", "0"): (None, 1, "before"), ("d", "1"): (None, 1, "body"), ("d", "1.1"): ("1", 2, ""), ("d", "1.2"): ("1", 2, "x\ny"), ("d", "2"): (None, 1, ""), ("d", "2.1.1"): ("2", 3, ""), ("d", "1_2"): (None, 1, ""), ("e", "1.1"): (None, 1, ""),
    }


def test_reading_order(spark):
    df = spark.createDataFrame([("p", 1, 0, 1, 50.0, 10.0, 60.0, 20.0, "b"), ("p", 1, 0, 0, 10.0, 10.0, 40.0, 20.0, "a"), ("p", 1, 1, 0, 10.0, 22.0, 40.0, 30.0, "c"), ("p", 0, 0, 0, 10.0, 1.0, 20.0, 5.0, "top"), ("p", 0, 0, 1, 0.0, 0.0, 0.0, 0.0, " ")], "page string, block int, line int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    got = docs.reading_order(df, ["page"]).orderBy("place").collect()
    assert [(r.text, r.x0, r.y1) for r in got] == [("top", 10.0, 5.0), ("a b\nc", 10.0, 30.0)]


def test_upserts(spark):
    old = spark.createDataFrame([("L", "1", {"a": "x", "b": "y"}), ("L", "2", None)], "label string, id string, props map<string,string>")
    new = spark.createDataFrame([("L", "1", {"a": "p"}, 1), ("L", "1", {"a": "q", "c": "r"}, 2), ("M", "1", {}, 3)], "label string, id string, props map<string,string>, seq int")
    got = {(r.label, r.id): r.props for r in ingest.upserted_nodes(old, new).collect()}
    assert got == {("L", "1"): {"a": "q", "b": "y", "c": "r"}, ("L", "2"): {}, ("M", "1"): {}}
    with pytest.raises(ValueError):
        ingest.must_be_new(old, new, "id")


def test_latest_and_scope(spark):
    rows = [(1, "A", 2020, 2019, 2020, 1), (2, "A", 2022, 2021, 2022, None), (3, "B", 2021, None, None, 2), (4, "B", 2020, None, None, 2), (5, "thong_bao_khac", 2022, None, None, 1)]
    df = spark.createDataFrame(rows, "id int, type string, year int, school_start int, school_end int, semester int")
    assert {r.id for r in scope.latest(df).collect()} == {2, 3}
    assert {r.id for r in scope.in_time(df, year=2021).collect()} == {2, 3} and {r.id for r in scope.in_time(df, semester=2, kind="B").collect()} == {3, 4}


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    page = {"ten_file": "f", "trang": [{"so_trang": 1, "kich_thuoc": [595, 842], "items": [{"loai": "van_ban", "bbox": [1, 2, 3, 4], "noi_dung": "x"}, {"loai": "bang", "bbox": [1], "du_lieu": [["a", None], [" b ", "c"]]}]}]}
    (tmp_path / "pages/a_raw.json").write_text(json.dumps(page))
    got = files.page_items(spark, str(tmp_path / "pages")).orderBy("pos").collect()
    assert [(r.kind, r.x1, r.cells) for r in got] == [("text", 3.0, None), ("table", 0.0, [["a", ""], ["b", "c"]])]
    (tmp_path / "trees").mkdir()
    sub = {"id": "s1", "ky_hieu": "1.1", "noi_dung": ["q"], "bang": [], "muc_con": []}
    tree = {"metadata": {"ten_file": "n"}, "tai_lieu": [{"id": "d1", "thu_tu": 1, "ten_tai_lieu": "t", "muc": [{"id": "s", "ky_hieu": "1", "noi_dung": ["p", "r"], "bang": [], "muc_con": [sub]}]}]}
    (tmp_path / "trees/n_chunks.json").write_text(json.dumps(tree))
    assert {(r.notice, r.id, r.parent_id, r.depth, r.text) for r in files.sections(spark, str(tmp_path / "trees")).collect()} == {("n", "s", None, 1, "p\nr"), ("n", "s1", "s", 2, "q")}
    case = {"id": "c", "question": "q", "evidence_groups": [{"name": "a", "any_of": ["1"]}, {"name": "b", "any_of": ["2"]}]}
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [case]}))
    assert files.cases(spark, str(tmp_path / "cases.json"), ["Multi-node"]).first().group == "Multi-node"
    with pytest.raises(ValueError):
        files.cases(spark, str(tmp_path / "cases.json"), ["Other"])
    (tmp_path / "up").mkdir()
    for i in range(3):
        (tmp_path / f"up/{i}.json").write_text(json.dumps({"k": i}))

    def handler(df, batch):
        if batch == 1:
            raise RuntimeError("broken batch")
        return df

    out = [str(tmp_path / x) for x in ("out", "progress", "checkpoint")]
    uploads.ingest(spark, str(tmp_path / "up"), "k long", handler, *out, files_per_batch=1).awaitTermination(120)
    status = {r.batch: (r.status, r.rows) for r in uploads.status(spark, out[1]).collect()}
    assert status == {0: ("completed", 1), 1: ("failed", 0), 2: ("completed", 1)} and spark.read.parquet(out[0]).count() == 2


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("điểm, \"x\"", "1")], "question string, n string")
    files.write_results(df, str(tmp_path / "r"))
    assert files.read_results(spark, str(tmp_path / "r"), ["question", "n"]).collect() == df.collect()
    with pytest.raises(ValueError):
        files.read_results(spark, str(tmp_path / "r"), ["question", "other"])
    both = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    files.refresh(both, str(tmp_path / "t"), "key")
    files.refresh(spark.createDataFrame([("b", 3)], "key string, v int"), str(tmp_path / "t"), "key")
    assert {(r.key, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 1), ("b", 3)}
