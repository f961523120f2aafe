"""Text, time and structure rules on hand-made inputs."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestack.functions import rects, text, vector


def each(spark, expression, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_fold(spark):
    given = ["Đăng ký học phần", "ẾỆỜỮ ñÇ", "é", None, "ĐIỀU"]
    assert each(spark, text.fold, given) == ["dang ky hoc phan", "eeou nc", "e", None, "dieu"]
    every = "".join(chr(c) for c in range(0x1EA0, 0x1EFA))
    plain = "".join(c for c in unicodedata.normalize("NFD", every.casefold()) if not unicodedata.combining(c))
    assert each(spark, text.fold, [every]) == [plain]


@pytest.mark.parametrize("question, start, end, year, semester", [
    ("HK1 năm học 2025-2026", 2025, 2026, None, 1), ("nghỉ lễ năm 2026", None, None, 2026, None), ("từ 2024 đến 2026 học kỳ 3", 2024, 2026, None, 3), ("", None, None, None, None), ("120261", None, None, None, None),
])
def test_time_scope(spark, question, start, end, year, semester):
    assert tuple(each(spark, text.time_scope, [question])[0]) == (start, end, year, semester)


def test_file_period(spark):
    df = spark.createDataFrame([("DRL_HK3_24_25", ""), ("x", "Học kỳ 2 năm học 2023-2024"), (None, None)], "a string, b string")
    assert [tuple(r.x) for r in df.select(text.file_period(F.col("a"), F.col("b")).alias("x")).collect()] == [(2024, 2025, 3), (2023, 2024, 2), (None, None, None)]


def test_entities(spark):
    given = ["Lớp CT219-01 K50", "MSSV B2405750", "xct2190", None]
    assert each(spark, text.course_code, given) == ["CT219", None, None, None]
    assert each(spark, text.student_code, given) == [None, "B2405750", None, None]
    assert each(spark, text.cohort, given) == ["K50", None, None, None]


def test_rewriting(spark):
    given = ["đkhp hk1 K50 sv", "ảhp hp", "ke hoach (KHHT) khht", "2024-2025 hp CT219HP môn học", "  \n", None, "K50sv sv", "hoc phan 12/3/2024 tc"]
    assert each(spark, text.normalised_query, given) == [
        "đăng ký học phần (ĐKHP) học kỳ 1 K50 sinh viên", "ảhp học phần", "ke hoach (KHHT) kế hoạch học tập (KHHT)", "2024-2025 học phần CT219HP học phần", "", "", "K50sv sinh viên", "học phần 12/3/2024 tín chỉ",
    ]


def test_safe_rewriting(spark):
    df = spark.createDataFrame([("CT219 hk1", "CT219 học kỳ 1"), ("CT219 hk1", "CT218 học kỳ 1"), ("a 1 2", "a 2 1"), ("a", " "), ("K 50", "khóa K50"), ("x", "y" * 501)], "a string, b string")
    assert [r.x for r in df.select(text.same_identifiers(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, False, True, False]


def test_issue_dates(spark):
    given = ["Cần Thơ, ngày 24 tháng 9 năm 2025", "Cần Thơ, ngày tháng năm 2026", "Căn cứ ngày 16 tháng 10 năm 2025", "Cần Thơ, ngày 31 tháng 2 năm 2025", "Cần Thơ ngày  tháng 3 năm 2024", None]
    assert each(spark, text.issue_date, given) == ["2025-09-24", "2026", None, None, "2024-03", None]
    assert [tuple(x) for x in each(spark, text.date_parts, ["2025-09-24", "2026", "x", None, "2024-13"])] == [(2025, 9, 24), (2026, 0, 0), (0, 0, 0), (0, 0, 0), (2024, 0, 0)]


def test_sections(spark):
    given = ["1.2. A", "3. B", "II. C", "Bước 2: D", "Điều 1. E", "plain", "1.2.3 deep", None]
    assert [x and tuple(x) for x in each(spark, text.section, given)] == [("1.2", 2), ("3", 1), ("II", 1), ("Bước 2", 1), ("Điều 1", 1), None, ("1.2.3", 3), None]


def test_references(spark):
    got = each(spark, text.structural_references, ["Điều 9 Khoản 1 Điểm a", "chương 2", "điều 3 khoản 2 và điều 5", "không"])
    assert [[tuple(r) for r in refs] for refs in got] == [[("point", None, "9", "1", "a")], [("chapter", "II", None, None, None)], [("clause", None, "3", "2", None), ("article", None, "5", None, None)], []]
    assert [[tuple(r) for r in refs] for refs in each(spark, text.cross_references, ["Xem Điều 4 Khoản 2; theo điểm b khoản 3 Điều 7", None])] == [[("4", "2", ""), ("7", "3", "b")], []]


def test_classifiers(spark):
    assert each(spark, text.question_type, ["đổi ngành", "lịch nghỉ tết", "chuyển ngành và điểm rèn luyện", ""]) == ["xet_chuyen_nganh", "lich_nghi", None, None]
    assert each(spark, text.domain, ["CT177 có học phần tiên quyết nào?", "Học phần tiên quyết là gì?", "xin chào", None, "abc"]) == ["CTDT", "QCHV", "SOCIAL", "SOCIAL", None]
    assert each(spark, text.title_type, ["Xét chuyển ngành", "Xóa lớp học phần", "Nghỉ Tết", "Khác"]) == ["xet_chuyen_nganh", "xoa_lop_hoc_phan", "lich_nghi", "thong_bao_khac"]
    assert each(spark, text.document_code, ["Số: 123 / TB-ĐHCT", "123/TB"]) == ["123/TB-ĐHCT", None]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = [r.x for r in df.select(vector.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-9 and got[1:] == [None, None, None]
    with pytest.raises(ValueError):
        vector.top_k(df, 0)


def test_page_numbers(spark):
    df = spark.createDataFrame([("3", 290.0, 800.0, 300.0, 815.0), ("3", 10.0, 800.0, 20.0, 815.0), ("abc", 290.0, 800.0, 300.0, 815.0), ("7", 290.0, 400.0, 300.0, 415.0)], "t string, x0 double, y0 double, x1 double, y1 double")
    assert [r.x for r in df.select(rects.page_number(F.col("t"), rects.rect(), F.lit(595.0), F.lit(842.0)).alias("x")).collect()] == [True, False, False, False]
