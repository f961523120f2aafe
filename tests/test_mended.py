"""Cases that went wrong once: point đ, letterheads, islands, marks of cuts, equal rows, caps on paths."""

from pyspark.sql import functions as F

from lodestack.functions import text
from lodestack.operators import cleaning, docs, graph, rank, tables


def test_points_d_and_dd_are_two(spark):
    asked = ["Điều 5 Khoản 2 Điểm đ", "điều 5 khoản 2 điểm d", "Dieu 5 khoan 2 diem a và Chương 3", "Điều 7"]
    at = spark.createDataFrame([(q,) for q in asked], "q string").select("q", F.inline(text.structural_references(F.col("q"))))
    got = {(r.q, r.kind): (r.chapter, r.article, r.clause, r.point) for r in at.collect()}
    assert got[asked[0], "point"] == (None, "5", "2", "đ") and got[asked[1], "point"] == (None, "5", "2", "d")
    assert got[asked[2], "point"] == (None, "5", "2", "a") and got[asked[2], "chapter"][0] == "III" and got[asked[3], "article"] == (None, "7", None, None)


def test_letterheads_are_no_content(spark):
    heads = ["BỘ GIÁO DỤC VÀ ĐÀO TẠO", "Đại học Cần Thơ", "TRƯỜNG ĐẠI HỌC CẦN THƠ", "BỘ GIÁO DỤC VÀ ĐÀO TẠO CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "ĐẠI HỌC CẦN THƠ ĐỘC LẬP – TỰ DO – HẠNH PHÚC"]
    lines = [*heads, "Đại học Cần Thơ thông báo", "KT. HIỆU TRƯỞNG", "PHÓ HIỆU TRƯỞNG"]
    at = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, pos int, line string")
    assert [r.line for r in cleaning.content_lines(at, ["doc_id"]).collect()] == ["Đại học Cần Thơ thông báo"]


def test_islands_against_a_plain_fold(spark):
    lines = ["one ends here.", "two goes", "on and", "- a bullet", "then more", "1. heading", "small again.", "x", "Y", "z"]
    want, last = [], None
    for i, x in enumerate(lines):
        goes_on = last is not None and not last[1].rstrip().endswith((".", "!", "?", ":", ";")) and x[0].islower()
        if goes_on:
            last[1] += " " + x
        else:
            last = [i, x]
            want.append(last)
    at = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, pos int, line string")
    got = docs.merged_islands(at, ["doc_id"], "pos", docs.continues(F.col("line"), F.col("before"))).orderBy("first").collect()
    assert [(r.first, r.text) for r in got] == [tuple(x) for x in want]


def test_cut_contexts_say_so(spark):
    at = spark.createDataFrame([(1, 1, "a" * 10), (1, 2, "one\ntwo\nthree more"), (2, 1, "x" * 50), (3, 1, "short")], "q long, position int, block string")
    got = {(r.q, r.position): r.fitted for r in rank.within_budget(at, 25, ["q"], ["position"], mark="[cut]").collect()}
    assert got == {(1, 1): "a" * 10, (1, 2): "one\ntwo\n[cut]", (2, 1): "[cut]", (3, 1): "short"}


def test_rows_equal_but_for_their_cells_stay_apart(spark):
    rows = [("t", 1, ["A", "B"], ["x", "y"]), ("t", 1, ["A", "B"], ["u", "v"]), ("t", 2, ["A", "B"], ["", "w"]), ("t", 2, ["A", "B"], ["", "w"])]
    at = spark.createDataFrame(rows, "t string, i int, headers array<string>, cells array<string>")
    got = sorted((r.i, list(r.cells)) for r in tables.forward_filled(at, ["t"], ["i"]).collect())
    assert got == [(1, ["u", "v"]), (1, ["x", "y"]), (2, ["x", "w"]), (2, ["x", "w"])]


def test_capped_expansion_keeps_what_the_whole_one_keeps(spark):
    edges = [("hub", f"n{i}", "A") for i in range(60)] + [(f"n{i}", f"m{i % 7}", "B") for i in range(60)] + [("s", "hub", "A"), ("s", "n1", "B"), ("s", "n10", "B")]
    e = spark.createDataFrame(edges, "src string, dst string, type string")
    seeds = spark.createDataFrame([("s",), ("hub",), ("alone",)], "id string")
    order = [F.col("depth"), F.array_join("nodes", ">")]
    for most in (1, 3, 20, 200):
        whole = graph.capped(graph.expanded(e, seeds, 2), order, most, 30).collect()
        assert sorted(whole) == sorted(graph.capped(graph.expanded(e, seeds, 2, most=most), order, most, 30).collect())
    none = graph.expanded(e, seeds, 1, ["C"])
    assert none.count() == graph.expanded(e, seeds, 1).count() and graph.expanded(e, seeds, 1, ["B"]).where("depth > 0").count() == 2
