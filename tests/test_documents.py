"""Regulations, curricula and cleaning on hand-made documents."""

from pyspark.sql import functions as F

from lodestack.operators import cleaning, curriculum, regulations


def lines(spark, *texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, pos int, line string")


def test_regulation_parts(spark):
    df = lines(
        spark, "QUYẾT ĐỊNH", "Điều 1. Ban hành", "kèm theo", "CHƯƠNG I", "QUY ĐỊNH CHUNG", "12", "Điều 2. Phạm vi", "và đối tượng", "1. Khoản một", "tiếp", "a) điểm a", "b) điểm b", "còn nữa", "2. Khoản hai", "a) lại a", "Chương II", "Điều 3. Cuối", "(xem Điều 1)", "Đoạn riêng",
    )
    got = [(r.chapter, r.article, r.clause, r.point, r.level, r.text) for r in regulations.parts(df).orderBy("pos").collect()]
    assert got == [
        (None, "1", None, None, "article", "Ban hành kèm theo"), ("CHƯƠNG I", "2", None, None, "article", "Phạm vi và đối tượng"), ("CHƯƠNG I", "2", "1", None, "clause", "Khoản một tiếp"), ("CHƯƠNG I", "2", "1", "a", "point", "điểm a"),
        ("CHƯƠNG I", "2", "1", "b", "point", "điểm b còn nữa"), ("CHƯƠNG I", "2", "2", None, "clause", "Khoản hai"), ("CHƯƠNG I", "2", "2", "a", "point", "lại a"), ("Chương II", "3", None, None, "article", "Cuối (xem Điều 1) Đoạn riêng"),
    ]
    tree = regulations.parts(df)
    asked = spark.createDataFrame([(1, "d", "clause", None, "2", "1", None), (2, "d", "chapter", "II", None, None, None), (3, "d", "point", None, "2", "2", "a")], "query int, doc_id string, kind string, chapter string, article string, clause string, point string")
    context = {r["query"]: r.context for r in regulations.looked_up(tree, asked).collect()}
    assert context == {1: "Khoản một tiếp\n\n---\n\nđiểm a\n\n---\n\nđiểm b còn nữa", 2: "Cuối (xem Điều 1) Đoạn riêng", 3: "lại a"}
    refs = spark.createDataFrame([(1, "d", "2", "1", "b"), (2, "d", "2", "1", "z"), (3, "d", "3", "", ""), (4, "d", "9", "", "")], "id int, doc_id string, article string, clause string, point string")
    assert {r.id: r.target for r in regulations.resolved(refs, tree).collect()} == {1: "2/1/b", 2: "2/1", 3: "3", 4: None}


def test_course_table(spark):
    rows = [
        ["BLOCK_HEADER: Khối A"], ["1", "CT 101", "Tin học (*)", "3", "3", "", "30", "30", "", ""], ["2", "AV001", "Anh", "4", "AV", "10 AV hoặc PV", "", "", "CT101", ""], ["3", "PV001", "Pháp", "4", "PV", "", "", "", "", "AV001"],
        ["Cộng: 14 TC (Bắt buộc: 4 TC; Tự chọn: 10 TC)"], ["BLOCK_HEADER: Khối B"], ["4", "CT201H", "Toán", "x", "2", "", "", "", "", ""], None,
    ]
    df = spark.createDataFrame([("p", i, r) for i, r in enumerate(rows)], "program string, pos int, cells array<string>")
    at = curriculum.course_rows(df)
    found = curriculum.courses(at)
    assert {(r.code, r.name, r.credits, r.parent, r.required) for r in found.collect()} == {("CT101", "Tin học", 3, "Khối A", True), ("AV001", "Anh", 4, "Khối A/10 AV hoặc PV/AV", False), ("PV001", "Pháp", 4, "Khối A/10 AV hoặc PV/PV", False), ("CT201H", "Toán", None, "Khối B", True)}
    assert {(r.src, r.dst) for r in curriculum.course_relations(found).where("type <> 'GOM'").collect()} == {("AV001", "CT101"), ("PV001", "AV001")}
    assert [(r.block, r.total, r.required, r.elective) for r in curriculum.block_credits(at).collect()] == [("Khối A", 14, 4, 10)]
    assert curriculum.renamed(spark.createDataFrame([("GOM_HOC_PHAN",), ("TUAN_THU",)], "type string")).orderBy("type").collect()[0].type == "GOM"


def test_sections(spark):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(["intro", "more", "## 1. A", "### x", "y", "## 2 B"])], "doc_id string, pos int, text string")
    assert [r.text for r in curriculum.sections(df).orderBy("pos").collect()] == ["intro", "more", "## 1. A\n\n### x\n\ny", "## 2 B"]


def test_content_lines(spark):
    df = lines(
        spark, "TRƯỜNG ĐẠI HỌC", "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "VÀ CÔNG NGHỆ", "Kính gửi:", "- Các khoa", "Phòng ban", "Căn cứ quy chế đào tạo, nhà trường thông báo như sau", "Nội dung một", "Trân trọng.", "Nguyễn Văn An", "HIỆU TRƯỞNG", "Trần Thị Bình", "Nơi nhận:", "Lưu",
    )
    assert [r.line for r in cleaning.content_lines(df, ["doc_id"]).orderBy("pos").collect()] == ["Căn cứ quy chế đào tạo, nhà trường thông báo như sau", "Nội dung một", "Nguyễn Văn An"]


def test_tables_over_pages(spark):
    rows = [("f", 1, 0, ["A", "B"], [["1", "2"]], "T"), ("f", 2, 0, ["a ", "B"], [["3", "4"]], None), ("f", 2, 1, None, None, None), ("f", 3, 0, ["A", "B"], [["5", "6"]], ""), ("f", 4, 0, ["A", "B"], [["7", "8"]], "Other")]
    df = spark.createDataFrame(rows, "file string, page int, pos int, headers array<string>, rows array<array<string>>, title string")
    got = [(r.page, r.title, r.rows, r.pages) for r in cleaning.continued_tables(df).orderBy("page").collect()]
    assert got == [(1, "T", [["1", "2"], ["3", "4"]], 2), (3, "", [["5", "6"]], 1), (4, "Other", [["7", "8"]], 1)]


def test_footnotes(spark):
    rows = [("d", 0, "text", "Sinh viên nộp đơni, rồi chờ."), ("d", 1, "text", "Xem đơni. và kết quảii."), ("d", 2, "note", "i. Đơn theo mẫu"), ("d", 3, "note", "ii. không có từ")]
    df = spark.createDataFrame(rows, "doc_id string, pos int, kind string, text string")
    assert [(r.pos, r.marker, r.ref_pos) for r in cleaning.footnotes(df).collect()] == [(2, "i", 1)]
    assert cleaning.footnotes(df.where(F.lit(False))).count() == 0
