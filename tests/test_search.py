"""Batches of searches, majors, choice of tables, repair of texts and audits, against plain Python."""

import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from lodestack.functions import text, vector
from lodestack.operators import audit, tables


def test_searched_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    v = {i: rng.normal(size=4).tolist() for i in range(60)} | {60: [0.0] * 4, 61: None, 62: [1.0, 2.0], 63: [1.0, 1.0, 0.0, 0.0], 64: [2.0, 2.0, 0.0, 0.0]}
    q = {0: v[0], 1: v[63], 2: [3.0, 6.0], 3: None, 4: [0.0] * 4}
    schema = "id long, embedding array<double>"
    found = vector.searched(spark.createDataFrame(list(q.items()), "query_id long, embedding array<double>"), spark.createDataFrame(list(v.items()), schema), 5, per_block=(2, 7))
    want = set()
    for a, x in q.items():
        scored = [(-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9), b) for b, y in v.items() if x and y and len(x) == len(y) and any(x) and any(y)]
        want |= {(a, b, r + 1) for r, (_, b) in enumerate(sorted(scored)[:5])}
    assert {(r.query_id, r.id, r["rank"]) for r in found.collect()} == want
    none = spark.createDataFrame([], schema)
    assert vector.searched(none.withColumnRenamed("id", "query_id"), none, 5).count() == 0


def test_majors_longest_then_smallest(spark):
    asked = spark.createDataFrame([(1, "Sinh viên ngành Công nghệ thông tin"), (2, "cong nghe"), (3, "gì"), (4, None)], "query_id int, question string")
    values = spark.createDataFrame([(i, m) for i in (1, 2, 4) for m in ("Công nghệ", "Công Nghệ Thông Tin", "", None, "công nghê")], "query_id int, value string")
    assert {r.query_id: r.major for r in tables.named_majors(asked, values, ["query_id"]).collect()} == {1: "Công Nghệ Thông Tin", 2: "Công nghệ"}


def test_relevant_tables(spark):
    rows = [("s", "a", True, None, "p", 1, True), ("s", "a", True, None, "p", 1, True), ("s", "b", True, 0.5, "p", 2, True), ("s", "c", False, 0.9, "p", 3, True), ("s", "d", True, 0.9, "p", 3, False),
            ("t", "e", False, None, "p", 1, True), ("t", "f", False, 0.1, "q", 1, True), ("t", "g", False, 0.1, "p", 1, True), ("u", "h", False, None, "p", 1, True), ("v", "i", True, 1.0, "p", 1, False)]
    found = tables.relevant(spark.createDataFrame(rows, "seed string, table_id string, direct boolean, score double, path string, seq int, eligible boolean"))
    assert {(r.seed, r.table_id, r.position) for r in found.collect()} == {("s", "a", 1), ("s", "b", 2), ("t", "g", 1), ("u", "h", 1)}


def plain_repair(t):
    t = unicodedata.normalize("NFKC", t or "").translate({0xA0: " ", 0x2007: " ", 0x202F: " ", 0xFEFF: None})
    t = t.replace("\uf0e0", " đến ").replace("\uf0b7", "-").replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"(?<=\d)\s*đến\s*(?=\d)", " đến ", t, flags=re.I)
    t = re.sub(r"\b([01]?\d|2[0-3])\s*:\s*([0-5]\d)\b", r"\1:\2", t)
    t = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", t))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def test_repaired_against_plain_python(spark):
    texts = ["7 : 30\uf0e09 :05", "1ĐẾN2", "\uf0b7 ﬁn\u00a0x\ufeff", " a \r\n\r\n\r\n b\t\tc ", "", None, "24 : 00 x5 : 10", "ngày 1\uf0e02", "ｆｕｌｌ①"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.repaired(F.col("t")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: plain_repair(t) for i, t in enumerate(texts)}
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert all(r.r == plain_repair(r.text) for r in own.select("text", text.repaired(F.col("text")).alias("r")).collect())


def test_audits_and_small_rules(spark):
    docs = spark.createDataFrame([(1, "a", "2020", "t", [1]), (2, None, "", "t", []), (3, "", None, None, None)], "id int, code string, issued string, title string, items array<int>")
    assert {r.id: len(r.warnings) for r in audit.document_warnings(docs).collect()} == {1: 0, 2: 3, 3: 4}
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, " "), (4, None), (5, "c")], "id int, text string")
    stored = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (5, None)], "id int, embedding array<double>")
    assert {r.id for r in audit.unembedded(nodes, stored, 2).collect()} == {2, 5}
    assert {r.id for r in audit.unembedded(nodes, stored, 2, force=True).collect()} == {1, 2, 5}
    rel = lambda h, q: spark.range(1).select(text.course_relations(F.lit(h).cast("array<string>") if h is None else F.array(*map(F.lit, h)), F.lit(q)).alias("r"), text.cohort_of_year(F.lit(2024)).alias("c"), text.regulation(F.lit(q)).alias("g")).first()
    assert rel(None, "Môn TIÊN QUYẾT và song hành?").r == ["YEU_CAU_TIEN_QUYET", "CO_THE_SONG_HANH"]
    assert rel(["x", " yeu_cau_tien_quyet ", "YEU_CAU_TIEN_QUYET"], "song hành").r == ["YEU_CAU_TIEN_QUYET"]
    assert rel(["x"], "học Online từ xa")[1:] == (50, "quydinhdaotaotructuyen") and rel(["x"], "gì")[::2] == ([], None)
