"""From document trees to answers: the built tables, then a batch of questions through every step."""

import json

from pyspark.sql import functions as F

from lodestack.plans import building, notifications
from lodestack.sources import files


def tree(sections):
    return {"metadata": {"ten_file": "x"}, "tai_lieu": [{"id": "d", "thu_tu": 1, "ten_tai_lieu": "t", "muc": sections}]}


def section(i, text, tables=(), inner=()):
    return {"id": i, "ky_hieu": i, "noi_dung": [text], "bang": [{"tieu_de_bang": "Bảng", "cot": c, "du_lieu": r} for c, r in tables], "muc_con": list(inner)}


def test_from_trees_to_answers(spark, tmp_path):
    courses = [["TT", "Mã HP", "Khóa"], [["1", "CT101", "K50"], ["2", "CT102", ""], ["3", "CT101", "K51"]]]
    (tmp_path / "A_HK1_24_25_chunks.json").write_text(json.dumps(tree([section("1", "Danh sách lớp", [courses], [section("1.1", "Ghi chú")])])))
    (tmp_path / "B_HK1_23_24_chunks.json").write_text(json.dumps(tree([section("1", "Danh sách cũ", [courses])])))
    (tmp_path / "C_chunks.json").write_text(json.dumps(tree([section("1", "Nghỉ Tết")])))
    titles = spark.createDataFrame([("A_HK1_24_25", "Xóa lớp học phần", "A_HK1_24_25", "2024-09-01"), ("B_HK1_23_24", "Xóa lớp học phần", "B_HK1_23_24", "2023-09-01"), ("C", "Lịch nghỉ Tết 2025", "C", "2025")], "notice string, title string, file string, issued string")
    parts = building.built(files.sections(spark, str(tmp_path)), titles)
    assert {r.label: r.n for r in building.counts(parts).collect()} == {"notices": 3, "sections": 4, "tables": 2, "rows": 6}
    rows = {r.id: r for r in parts["rows"].collect()}
    assert rows["A_HK1_24_25_1_bang_1_dong_2"].cells == ["2", "CT102", "K50"] and "Mã HP: CT102\nKhóa: K50" in rows["A_HK1_24_25_1_bang_1_dong_2"].text
    assert building.edges(parts).count() == 4 + 2 + 6
    known = {r.id: r for r in parts["notices"].collect()}
    assert (known["A_HK1_24_25"].type, known["A_HK1_24_25"].school_end, known["A_HK1_24_25"].semester, known["C"].type, known["C"].year) == ("xoa_lop_hoc_phan", 2025, 1, "lich_nghi", 2025)
    spot = lambda df, n: df.withColumn("embedding", F.array(F.lit(1.0), F.lit(float(n)) + F.length("id") % 7))
    asked = [(1, "Lớp CT101 K50 bị xóa?", [1.0, 0.0]), (2, "Danh sách lớp học phần bị xóa năm học 2023-2024", [1.0, 1.0]), (3, "nghỉ tết khi nào", [1.0, 2.0]), (4, "CT999 có bị xóa lớp học phần?", [1.0, 0.0])]
    questions = spark.createDataFrame(asked, "query_id int, question string, embedding array<double>")
    model = notifications.Model(parts["notices"], spot(parts["sections"], 1), parts["tables"], spot(parts["rows"], 2))
    got = notifications.answered(questions, model).collect()
    of = lambda q: [(r.id, r.source) for r in sorted(got, key=lambda r: r.position) if r.query_id == q]
    assert of(1) == [("A_HK1_24_25_1_bang_1_dong_1", "exact")]  # the latest notice of its type; the cohort rules out the third row
    assert {i for i, _ in of(2)} == {"B_HK1_23_24_1_bang_1_dong_1", "B_HK1_23_24_1"}
    assert of(3) == [("C_1", "vector")] and of(4) == []  # an exact value that nothing has is not searched by vector
    block = next(r.fitted for r in got if r.query_id == 2 and r.id.endswith("dong_1"))
    assert "CT102" in block and "Danh sách cũ" in block  # a list brings the other rows, and the section


def test_history(spark):
    rows = [(1, i, "user" if i % 2 else "system", f"t{i}" if i != 5 else " ") for i in range(10)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert building.last_turns(df, 6).first().history == "user: t4\nuser: t6\nuser: t7\nuser: t8\nuser: t9"
