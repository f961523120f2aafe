"""Blocks, overlays, titles, curricula, grades and deleting of trees: hand-made and odd cases, and plain Python."""

import random

from pyspark.sql import functions as F

from lodestack.functions import blocks
from lodestack.operators import curriculum, evaluate, ingest, pages, regulations


def test_kinds_of_odd_blocks(spark):
    cases = {
        None: "doan_van", "": "doan_van", " \n\t": "doan_van", "\n  Số : 5/QĐ": "metadata", "Số lượng": "doan_van", "cần thơ, NGÀY 1": "metadata", "Danh sách có : 3": "ghi_chu", "Danh sách lớp": "tieu_de",
        "GHI CHÚ: x": "ghi_chu", "(x)": "ghi_chu", "• x": "bullet", "v/V nghỉ": "tieu_de", "Về việc": "tieu_de", "Thông báoX": "doan_van", "IV. Điều": "heading", "1) a": "heading", "1.2.3 a": "heading", "2024": "doan_van",
        "Bước 2: nộp": "heading", "ĐẠI HỌC\n2": "heading", "ĐẠI HỌC\nb": "doan_van", "Đ" * 241: "doan_van", "iv chú thích": "doan_van", "x" * 100_000: "doan_van",
    }
    at = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", blocks.kind(F.col("t")).alias("k"), blocks.kind(F.col("t"), F.lit(95.0), F.lit(100.0)).alias("low"))
    found = {r.i: (r.k, r.low) for r in at.collect()}
    assert [found[i][0] for i in range(len(cases))] == list(cases.values())
    assert [found[i][1] for i, t in enumerate(cases) if t == "iv chú thích"] == ["ghi_chu"]


def test_lines_titles_and_starts(spark):
    row = spark.range(1).select(
        *(blocks.goes_on(F.lit(t)).alias(f"g{i}") for i, t in enumerate(["đơn", "Đơn", "2 đơn", "(a", "https://A", "A.B@C.VN x", "", None])),
        *(blocks.titles_overlap(F.lit(a), F.lit(b)).alias(f"t{i}") for i, (a, b) in enumerate([("Nghỉ Tết!", "về việc NGHỈ  TẾT"), ("a", None), ("!", "x"), ("xa", "ya")])),
        *(blocks.document_start(F.lit(a), F.lit(k)).alias(f"d{i}") for i, (a, k) in enumerate([("thông báo x", "heading"), ("THÔNG BÁO x", "heading"), ("THÔNG BÁO x", "bullet"), ("THÔNG BÁO X", "bullet"), ("V/v x", "tieu_de"), (None, None)])),
        blocks.ends_sentence(F.lit("x: ")).alias("e"), blocks.ends_sentence(F.lit("x:"), strong=True).alias("f"),
    ).first()
    assert list(row) == [True, False, True, True, True, True, False, False, True, False, False, False, False, True, False, True, True, False, True, False]


def test_overlays_are_taken_in_order_like_plain_python(spark):
    rng = random.Random(5)
    rows = []
    for page in range(30):
        for pos in range(rng.randrange(1, 12)):
            y, x = float(rng.randrange(0, 60, 3)), float(rng.randrange(50))
            rows.append((page, pos, rng.choice(["Số: 1/x\n12", "12", "3\n4", "text", "1\n2\n3\n4", None, ""]), x, y, x + 9, y + rng.choice([0.5, 8.0, 12.0])))
    want, gone = {}, set()
    for page in range(30):
        own = [r for r in rows if r[0] == page]
        for r in own:
            want[page, r[1]] = [r[2] or "", *r[3:], False]
        for m in own:
            if (m[2] or "").startswith("Số"):
                want[page, m[1]] = ["Số: 1/x", *m[3:], True]
                scores = []
                for o in own:
                    if o[2] in ("12", "3\n4") and (page, o[1]) not in gone:
                        v = max(0.0, min(m[6], o[6]) - max(m[4], o[4])) / max(1.0, min(m[6] - m[4], o[6] - o[4]))
                        d = abs((m[4] + m[6]) / 2 - (o[4] + o[6]) / 2)
                        if v > 0 or d <= 20:
                            scores.append((v * 10 - d / 100, o[1], o))
                if scores:
                    o = max(scores, key=lambda s: s[:2])[2]
                    gone.add((page, o[1]))
                    want[page, m[1]][1:5] = [min(m[3], o[3]), min(m[4], o[4]), max(m[5], o[5]), max(m[6], o[6])]
    df = spark.createDataFrame(rows, "page int, pos int, text string, x0 double, y0 double, x1 double, y1 double")
    found = {(r.page, r.pos): [r.text or "", r.x0, r.y0, r.x1, r.y1, r.is_metadata] for r in pages.without_overlays(df, ["page"]).collect()}
    assert gone and found == {k: v for k, v in want.items() if k not in gone}
    assert pages.without_overlays(df.limit(0), ["page"]).count() == 0


def test_titles(spark):
    items = [("a", 1, "tieu_de", "QUYẾT ĐỊNH"), ("a", 2, "doan_van", "x\nV / v : họp "), ("a", 3, "metadata", "Về việc - thi"), ("b", 1, "tieu_de", "Phụ lục 1\nx"), ("b", 2, "tieu_de", "(kèm)"), ("b", 4, "tieu_de", "Thông  báo\nLịch\n(b) \nthi"), ("c", 1, None, None)]
    files = [("a", "x"), ("b", "x"), ("c", "d/1_THÔNG BÁO_nghỉ__Tết.signed.pdf"), ("d", "v/v.pdf"), ("e", None), ("f", "")]
    out = pages.titles(spark.createDataFrame(items, "doc string, pos int, kind string, text string"), spark.createDataFrame(files, "doc string, name string"))
    assert {r.doc: r.title for r in out.collect()} == {"a": "Về việc thi", "b": "Lịch thi", "c": "Về việc nghỉ Tết", "d": "", "e": "", "f": ""}


def test_outcomes_without_headers_and_with_many(spark):
    lines = ["- một", None, " ", "2.1.1. Con", "* (cdr7) hai ;", "2.2 Mẹ **", "x. ba", "xx. bốn", "- năm"] + ["+ x"] * 100
    out = curriculum.outcomes(spark.createDataFrame([("p", i, t) for i, t in enumerate(lines)], "program string, pos int, line string")).orderBy("pos").collect()
    assert [tuple(r)[2:] for r in out[:4]] == [("CDR_01", "một", "Chung", "Chung"), ("CDR7", "hai", "Chung", "Con"), ("CDR_02", "ba", "Mẹ", "Chung"), ("CDR_03", "năm", "Mẹ", "Chung")]
    assert out[-1].code == "CDR_103" and len(out) == 104


def test_plans_of_nothing(spark):
    none, t = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    row = spark.range(1).select(curriculum.plan(none, none, none, none, t, t, F.lit("1000"), t).alias("p"), curriculum.program_filter(t, t).alias("f"), curriculum.query_type(t).alias("q"), curriculum.concept(t).alias("c")).first()
    assert tuple(row.p) == ([], [], 2, 120, 120, "summary") and tuple(row.f) == (51, "đại trà", True) and (row.q, row.c) == ("description", "UNKNOWN")


def test_hybrid_caps(spark):
    graphs = spark.createDataFrame([(1, 0, 0, 0), (2, 2, 1, 0), (3, 1, 0, 180), (4, 5, 0, 179)], "query_id int, n_nodes int, n_edges int, n_chars int")
    candidates = spark.createDataFrame([(q, t, f"{t}{i}", 1.0 if i < 2 else 0.5) for q in (1, 2, 3, 4) for t in "ab" for i in range(5)], "query_id int, target string, id string, score double")
    edges = spark.createDataFrame([(f"{t}{i}", f"d{j}", r) for t in "ab" for i in range(4) for j in range(6) for r in ("A", "N", "A")], "src string, dst string, type string")
    out = curriculum.hybrid(graphs, candidates, edges, ("A",)).collect()
    assert {r.query_id for r in out} == {1, 4}
    assert sorted(r.id for r in out if r.query_id == 1 and r.origin is None) == ["a0", "a1", "a2", "b0", "b1", "b2"]
    steps = sorted((r.origin, r.id) for r in out if r.query_id == 4 and r.origin is not None)
    assert steps == [(f"{t}{i}", f"d{j}") for t in "ab" for i in range(3) for j in range(2)]


def test_grades_order_and_k(spark):
    rows = spark.createDataFrame([("a", 1, None, "UNGRADED"), ("b", None, 0, "RUNTIME_X"), ("c", 0, 1, "GOLD_AUDIT"), ("d", 0, None, "UNGRADED")], "id string, final_hit int, accurate int, error_class string")
    out = evaluate.graded(rows, spark.createDataFrame([("a", 1), ("b", 1), ("c", None), ("z", 1)], "id string, grade int"))
    got = [tuple(r)[:4] for r in evaluate.ordered(out, spark.createDataFrame([("c", 1), ("a", 2), ("y", 0)], "id string, pos int")).select("id", "accurate", "error_class", "known").collect()]
    assert got == [("c", 1, "GOLD_AUDIT", True), ("a", 1, "OK", True), ("b", 1, "RUNTIME_X", False), ("d", None, "UNGRADED", False)]
    runs = spark.createDataFrame([("x", "6"), ("x", " 6"), ("y", "6"), ("y", "5"), ("z", "0"), ("w", None), ("v", "a")], "run string, top_k string")
    assert {r.run: (r.top_k, r.fault) for r in evaluate.stored_k(runs).collect()} == {"x": (6, None), "y": (None, "more than one top_k"), **dict.fromkeys("zwv", (None, "invalid top_k"))}


def test_trees_go_with_their_edges(spark):
    nodes = spark.createDataFrame([(i,) for i in "rabcdexy"], "id string")
    edges = spark.createDataFrame([("r", "a", "t"), ("r", "a", "u"), ("a", "b", "t"), ("b", "c", "t"), ("c", "d", "t"), ("d", "e", "t"), ("x", "c", "t"), ("x", "y", "t")], "src string, dst string, type string")
    left, kept, counts = ingest.without_trees(nodes, edges, spark.createDataFrame([("r",), ("none",)], "id string"))
    assert sorted(r.id for r in left.collect()) == ["e", "x", "y"] and [tuple(r) for r in kept.collect()] == [("x", "y", "t")]
    assert {r.root: r.n for r in counts.collect()} == {"r": 5, "none": 0}


def test_sizes_of_regulations(spark):
    lines = ["Chương I", "Điều 1. Một", "1. k", "a) p", "b) q", "Điều 2. Hai", "Chương II", "Điều 3. Ba"]
    tree = regulations.parts(spark.createDataFrame([("r", i, t) for i, t in enumerate(lines)], "doc_id string, pos int, line string"))
    row = regulations.sizes(tree).first()
    assert tuple(row) == ("r", 9, 8, 3)
