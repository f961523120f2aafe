"""Documents built from blocks: wrapped lines, pieces, titles of tables, first items of pages."""

from pyspark.sql import functions as F

from lodestack.operators import building, hierarchy


def pieces(spark, text, kind="doan_van"):
    df = spark.createDataFrame([(1, 0, text, kind, 0.0, 100.0)], "doc int, pos int, text string, kind string, y0 double, y1 double")
    return [(r.kind, r.text, r.y0, r.y1) for r in building.segments(df, ["doc"], "pos").orderBy("seg").collect()]


def test_pieces_of_a_block(spark):
    assert pieces(spark, "Sinh viên nộp\nđơn trước ngày\n15/3.") == [("doan_van", "Sinh viên nộp đơn trước ngày 15/3.", 0, 100)]
    assert pieces(spark, "Điều 5. Phạm vi") == [("heading", "Điều 5. Phạm vi", 0, 100)] and pieces(spark, "- một mục") == [("doan_van", "- một mục", 0, 100)]
    got = pieces(spark, "Mở đầu.\n1. Phạm vi\náp dụng\nCho mọi lớp\nvà khoa.\n- nghỉ;\n- học-\nbù")
    assert [(k, t) for k, t, *_ in got] == [("doan_van", "Mở đầu."), ("heading", "1. Phạm vi áp dụng"), ("doan_van", "Cho mọi lớp và khoa."), ("bullet", "- nghỉ;"), ("bullet", "- họcbù")]
    assert [(a, b) for *_, a, b in got] == [(0, 12.5), (12.5, 37.5), (37.5, 62.5), (62.5, 75), (75, 100)]
    assert pieces(spark, "năm 2025-\n2026 và Hà-\nNội") == [("doan_van", "năm 2025-2026 và Hà-Nội", 0, 100)]
    assert pieces(spark, "một\n\nhai") == [("doan_van", "một hai", 0, 100)] and pieces(spark, " \n ") == [] and pieces(spark, None) == []


def test_content_goes_on_over_blocks(spark):
    rows = [
        (1, "text", "doan_van", "Sinh viên các"), (2, "text", "doan_van", "khóa nộp đơn."), (3, "text", "doan_van", "Phòng nhận"), (4, "table", "", None), (5, "text", "doan_van", "trả lời"),
        (6, "text", "tieu_de", "PHỤ LỤC 1"), (7, "text", "doan_van", "của Hiệu trưởng (kèm theo)"), (8, "text", "doan_van", "nội dung"), (9, "text", "bullet", "- mục"), (10, "text", "doan_van", " "),
    ]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc int, pos int, item string, kind string, text string")
    got = [(r["first"], r.item, r.text, r.n) for r in building.content(df, ["doc"], ["pos"]).orderBy("first").collect()]
    assert [x[1:] for x in got] == [("text", "Sinh viên các khóa nộp đơn.", 2), ("text", "Phòng nhận", 1), ("table", None, 1), ("text", "trả lời", 1), ("text", "PHỤ LỤC 1", 1), ("text", "nội dung", 1), ("text", "- mục", 1)]


def test_titles_and_first_items(spark):
    rows = [(1, "heading", "1. Lớp mở"), (2, "doan_van", "Kết quả cụ thể như sau:"), (3, None, None), (4, "doan_van", "Ghi lại."), (5, None, None), (6, "tieu_de", "DANH SÁCH lớp"), (7, "tieu_de", "Lịch học"), (8, None, "Thông báo X"), (9, "bullet", "+ Danh mục"), (10, None, "Bảng 1")]
    df = spark.createDataFrame([(1, p, "table" if k is None else "text", k, None if k is None else t, t if k is None else None, 1 if p < 6 else 2) for p, k, t in rows], "doc int, pos int, item string, kind string, text string, title string, page int")
    got = {r.pos: r.found for r in building.table_titles(df.withColumn("doc_title", F.lit("Thông báo X")), "doc").collect()}
    assert got == {3: "1. Lớp mở", 5: "", 8: "DANH SÁCH lớp", 10: "Bảng 1"}
    titles = spark.createDataFrame([(1, "1. lớp mở rộng")], "doc int, doc_title string")
    first = {r.page: r.pos for r in building.meaningful(df.withColumn("kind", F.when(F.col("pos") == 1, "tieu_de").otherwise(F.col("kind"))), "doc", titles).where("starts_page").collect()}
    assert first == {1: 2, 2: 6}


def test_documents_inside_files(spark):
    rows = [
        ("text", "doan_van", "Mở đầu", ""), ("text", "ghi_chu", "Lưu ý: các điểm", ""), ("text", "doan_van", "1. không phải mục", ""), ("text", "heading", "2. Mục hai", ""), ("text", "doan_van", "2.1 Mục con", ""),
        ("table", "", None, "DANH SÁCH lớp"), ("table", "", None, "DANH SÁCH lớp"), ("text", "tieu_de", "QUYẾT ĐỊNH mới", ""), ("table", "", None, "Quyết định mới"), ("text", "doan_van", "3.1 Đầu tiên", ""),
    ]
    df = spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows)], "file string, pos int, item string, kind string, text string, title string")
    at = hierarchy.lexed(df, "file")
    got = [(r.doc_no, r.symbol, r.said) for r in at.orderBy("pos").collect()]
    assert got == [(1, None, "Mở đầu"), (1, None, "Lưu ý: các điểm"), (1, None, "1. không phải mục"), (1, "2", "2. Mục hai"), (1, "2.1", "2.1 Mục con"), (2, None, "DANH SÁCH lớp"), (2, None, None), (3, None, "QUYẾT ĐỊNH mới"), (3, None, None), (3, "3.1", "3.1 Đầu tiên")]
    trees = hierarchy.trees(at, ["file", "doc_no"], "pos", F.col("item") == "table").collect()
    assert {(r.doc_no, r.id): (r.parent_id, r.level, r.text, r.n_tables) for r in trees} == {
        (1, "0"): (None, 1, "Mở đầu\nLưu ý: các điểm\n1. không phải mục", 0), (1, "2"): (None, 1, "", 0), (1, "2.1"): ("2", 2, "", 0),
        (2, "0"): (None, 1, "DANH SÁCH lớp", 2), (3, "0"): (None, 1, "QUYẾT ĐỊNH mới", 1), (3, "3.1"): ("0", 2, "", 0),
    }
