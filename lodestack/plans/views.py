"""The tables of the star schema as the engine's model: notices, rows of tables, graph nodes and edges, questions.

Each view has a SQL twin of the same name in ``SQL``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notices: the priority is the type, the date of issue gives the school year but for type 5-LOW."""
    o = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")).withColumn("m", F.month("o_orderdate"))
    start = F.when(F.col("o_orderpriority") != "5-LOW", F.col("y") - (F.col("m") < 8).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "thong_bao_khac").otherwise(F.col("o_orderpriority")).alias("type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued"), F.col("y").alias("year"), start.alias("school_start"), (start + 1).alias("school_end"),
        F.when(F.col("m") % 5 > 0, F.floor((F.col("m") - 1) / 4).cast("int") + 1).alias("semester"),
    )


def headed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of tables with one of four headers; every seventh supplier's rows lack their last cell."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.col("l_orderkey") % 4
    code = F.concat(F.lit("CT"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"))
    cohort = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "K").otherwise("Khóa "), (F.lit(48) + F.col("l_suppkey") % 5).cast("string"))
    quantity = F.col("l_quantity").cast("int").cast("string")
    texts = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))
    headers = F.when(kind == 0, texts("Mã HP", "Khóa", "Số lượng")).when(kind == 1, texts("Mã sinh viên", "Ngành học")).when(kind == 2, texts("Nội dung", "Khóa học")).otherwise(texts("STT", "mã học phần"))
    cells = F.when(kind == 0, texts(code, cohort, quantity)).when(kind == 1, texts(F.concat(F.lit("B"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")), F.col("l_returnflag"))).when(kind == 2, texts(quantity, cohort)).otherwise(texts(F.col("l_linenumber").cast("string"), F.lower(code)))
    short = F.col("l_suppkey") % 7 == 0
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", headers.alias("headers"), F.when(short, F.slice(cells, F.lit(1), F.size(cells) - 1)).otherwise(cells).alias("cells"))


EDGES = (
    ("nation", "region", "n_regionkey", "nation", "n_nationkey", "HAS_NATION"), ("customer", "nation", "c_nationkey", "customer", "c_custkey", "HAS_CUSTOMER"),
    ("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", "HAS_SUPPLIER"), ("orders", "customer", "o_custkey", "order", "o_orderkey", "HAS_ORDER"),
)
NODES = (("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("orders", "order", "o_orderkey", "o_orderpriority"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys of the star as edges from the one to the many."""
    one = lambda t, a, ka, b, kb, kind: table(spark, sf_dir, t).select(F.concat_ws(":", F.lit(a), ka).alias("src"), F.concat_ws(":", F.lit(b), kb).alias("dst"), F.lit(kind).alias("type"))
    return reduce(DataFrame.unionByName, (one(*e) for e in EDGES))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, label, key, name: table(spark, sf_dir, t).select(F.concat_ws(":", F.lit(label), key).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"))
    return reduce(DataFrame.unionByName, (one(*n) for n in NODES))


QUESTION_FORMS = 10


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question for each conversation turn, in one of ten forms."""
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 8 + F.col("turn")
    year = F.lit(2020) + F.col("conv_id") % 8
    code = F.concat(F.lit("CT"), F.lpad((F.col("conv_id") % 1000).cast("string"), 3, "0"))
    half = (F.col("turn") % 3 + 1).cast("string")
    forms = [
        F.concat(F.lit("Lịch nghỉ Tết năm "), year, F.lit(" khi nào?")),
        F.concat(F.lit("Danh sách sinh viên bị xóa lớp học phần "), code, F.lit(" HK"), half, F.lit(" năm học "), year, F.lit("-"), year + 1),
        F.concat(code, F.lit(" có học phần tiên quyết nào?")),
        F.lit("Học phần tiên quyết là gì?"),
        F.concat(F.lit("Điều "), F.col("conv_id") % 30 + 1, F.lit(" Khoản "), half, F.lit(" Điểm "), F.element_at(F.array(*map(F.lit, ("a", "đ", "d"))), (F.col("conv_id") % 3 + 1).cast("int")), F.lit(" quy định gì?")),
        F.concat(F.lit("đkhp hk"), half, F.lit(" K"), F.lit(45) + F.col("turn") % 6, F.lit("  sv ngành cntt")),
        F.lit("Xin chào!"),
        F.concat(F.lit("Điểm rèn luyện của B"), F.lpad(F.col("conv_id").cast("string"), 7, "2"), F.lit(" và chuyển ngành, môn học  nào?")),
        F.concat(F.lit("Chương "), F.col("conv_id") % 20 + 1, F.lit(" điều "), F.col("turn") + 1),
        F.concat(F.col("role"), F.lit(": "), F.col("text")),
    ]
    return c.select("conv_id", "turn", F.element_at(F.array(*forms), (n % QUESTION_FORMS + 1).cast("int")).alias("question"))


def _edges_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{a}:' || {ka} AS src, '{b}:' || {kb} AS dst, '{kind}' AS type FROM {t}" for t, a, ka, b, kb, kind in EDGES)


def _nodes_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{label}:' || {key} AS id, '{label}' AS label, {name} AS name FROM {t}" for t, label, key, name in NODES)


FOLD = "replace(strip_accents(lower({})), 'đ', 'd')"

SQL = {
    "notices": """notices AS (
        SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'thong_bao_khac' ELSE o_orderpriority END AS type,
               strftime(o_orderdate, '%Y-%m-%d') AS issued, CAST(year(o_orderdate) AS INT) AS year,
               CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 8 THEN 1 ELSE 0 END AS INT) END AS school_start,
               CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 8 THEN 1 ELSE 0 END + 1 AS INT) END AS school_end,
               CASE WHEN month(o_orderdate) % 5 > 0 THEN CAST((month(o_orderdate) - 1) // 4 + 1 AS INT) END AS semester FROM orders)""",
    "headed_rows": """headed_rows0 AS (
        SELECT *, 'CT' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') AS code, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q,
               CASE WHEN l_linenumber % 2 = 0 THEN 'K' ELSE 'Khóa ' END || CAST(48 + l_suppkey % 5 AS VARCHAR) AS cohort FROM lineitem),
        headed_rows1 AS (
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
               CASE l_orderkey % 4 WHEN 0 THEN ['Mã HP', 'Khóa', 'Số lượng'] WHEN 1 THEN ['Mã sinh viên', 'Ngành học'] WHEN 2 THEN ['Nội dung', 'Khóa học'] ELSE ['STT', 'mã học phần'] END AS headers,
               CASE l_orderkey % 4 WHEN 0 THEN [code, cohort, q] WHEN 1 THEN ['B' || lpad(CAST(l_partkey AS VARCHAR), 7, '0'), l_returnflag] WHEN 2 THEN [q, cohort] ELSE [CAST(l_linenumber AS VARCHAR), lower(code)] END AS cells FROM headed_rows0),
        headed_rows AS (SELECT * REPLACE (CASE WHEN l_suppkey % 7 = 0 THEN cells[1:len(cells) - 1] ELSE cells END AS cells) FROM headed_rows1)""",
    "edges": f"edges AS ({_edges_sql()})",
    "nodes": f"nodes AS ({_nodes_sql()})",
    "questions": """questions AS (
        SELECT conv_id, turn, [
            'Lịch nghỉ Tết năm ' || (2020 + conv_id % 8) || ' khi nào?',
            'Danh sách sinh viên bị xóa lớp học phần CT' || lpad(CAST(conv_id % 1000 AS VARCHAR), 3, '0') || ' HK' || (turn % 3 + 1) || ' năm học ' || (2020 + conv_id % 8) || '-' || (2021 + conv_id % 8),
            'CT' || lpad(CAST(conv_id % 1000 AS VARCHAR), 3, '0') || ' có học phần tiên quyết nào?',
            'Học phần tiên quyết là gì?',
            'Điều ' || (conv_id % 30 + 1) || ' Khoản ' || (turn % 3 + 1) || ' Điểm ' || ['a', 'đ', 'd'][conv_id % 3 + 1] || ' quy định gì?',
            'đkhp hk' || (turn % 3 + 1) || ' K' || (45 + turn % 6) || '  sv ngành cntt',
            'Xin chào!',
            'Điểm rèn luyện của B' || lpad(CAST(conv_id AS VARCHAR), 7, '2') || ' và chuyển ngành, môn học  nào?',
            'Chương ' || (conv_id % 20 + 1) || ' điều ' || (turn + 1),
            role || ': ' || text][(conv_id * 8 + turn) % 10 + 1] AS question FROM conversations)""",
}

