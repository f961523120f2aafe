"""Catalogue: course tables from ruled pages, programs as nodes and edges, graphs and hits as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import render, vector
from lodestack.operators import graph, program_nodes, ruled
from lodestack.plans.registry import query
from lodestack.plans.views import table
from lodestack.sources.shared import spread

#: Line items of a task: a page's lines and words are ten times as many.
ROWS_A_TASK = 100_000

RULED = """li AS (SELECT l_orderkey AS page, l_linenumber AS line, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
    rw AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY line) AS r FROM li),
    ce AS (SELECT page, r, CASE WHEN line = 3 THEN ['Khối kiến thức ' || (page % 5), '', ''] ELSE ['CT' || lpad(CAST(part % 1000 AS VARCHAR), 3, '0'), 'Môn ' || supp, CAST(CAST(q AS INT) AS VARCHAR)] END AS cells, line = 3 AS block FROM rw
           UNION ALL SELECT DISTINCT page, 0, ['Mã số', 'Tên học phần', 'TC'], false FROM rw)"""


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as pages with a ruled table of three columns: the lines, each in pieces and a little off, and the words. Third lines
    are one cell with the name of a block."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("q"))
    # dealt by page once; what is made of a page stays where it is
    li = spread(li, ["page"], li.count(), ROWS_A_TASK).groupBy("page", "line").agg(F.min("part").alias("part"), F.min("supp").alias("supp"), F.min("q").alias("q"))
    rows = li.withColumn("r", F.row_number().over(Window.partitionBy("page").orderBy("line")))
    some = rows.groupBy("page").agg(F.max("r").alias("n"))
    d = lambda c: c.cast("double")
    flat = some.select("page", F.explode(F.sequence(F.lit(0), F.col("n") + 1)).alias("i")).select("page", "i", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"))
    y = d(F.col("i") * 20) + F.col("c") % 2 * 1.5
    flat = flat.select("page", d(F.col("c") * 100).alias("x0"), y.alias("y0"), d(F.col("c") * 100 + 100).alias("x1"), y.alias("y1"))
    every = rows.select("page", "r", (F.col("line") == 3).alias("block")).unionByName(some.select("page", F.lit(0).alias("r"), F.lit(False).alias("block")))
    up = every.select("page", "r", F.explode(F.when(F.col("block"), F.array(F.lit(0), F.lit(3))).otherwise(F.array(*map(F.lit, range(4))))).alias("c"))
    x = d(F.col("c") * 100 + F.col("r") % 2 * 2)
    up = up.select("page", x.alias("x0"), d(F.col("r") * 20).alias("y0"), x.alias("x1"), d(F.col("r") * 20 + 20).alias("y1"))
    code = F.concat(F.lit("CT"), F.lpad((F.col("part") % 1000).cast("string"), 3, "0"))
    word = lambda text, at, r: F.struct(text.cast("string").alias("text"), F.lit(float(at)).alias("x0"), (F.lit(at) + 20.0).alias("x1"), d(r * 20 + 5).alias("y0"), d(r * 20 + 15).alias("y1"), F.lit(at).alias("word_no"))
    r = F.col("r")
    said = F.when(F.col("line") == 3, F.array(word(F.lit("Khối  kiến"), 120, r), word(F.concat(F.lit("thức "), F.col("page") % 5), 145, r))).otherwise(F.array(word(code, 10, r), word(F.lit("Môn"), 110, r), word(F.col("supp"), 135, r), word(F.col("q").cast("int"), 210, r)))
    head = some.select("page", F.lit(0).alias("r")).select("page", F.array(*(word(F.lit(t), at, F.col("r")) for t, at in (("Mã số", 10), ("Tên", 110), ("học", 131), ("phần", 152), ("TC", 220)))).alias("w"), F.lit(0).alias("r"))
    words = rows.select("page", said.alias("w"), "r").unionByName(head)
    words = words.select("page", "r", F.explode("w").alias("w")).select("page", (F.col("r") * 1000 + F.col("w.word_no")).alias("word_no"), "w.x0", "w.y0", "w.x1", "w.y1", "w.text")
    return flat.unionByName(up), words


@query(f"WITH {RULED} SELECT page, CAST(r AS BIGINT) AS r, array_to_string(cells, '|') AS cells FROM ce")
def ruled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all pages' tables, from lines and words."""
    lines, words = _pages(spark, sf_dir)
    return ruled.cells(words, lines, ["page"]).select("page", F.col("r").cast("long").alias("r"), F.array_join("cells", "|").alias("cells"))


@query(f"""WITH {RULED}, f AS (SELECT o_custkey AS file, page, r, cells, block, row_number() OVER (PARTITION BY o_custkey ORDER BY page, r) AS i FROM ce JOIN orders ON o_orderkey = page)
           SELECT file, row_number() OVER (PARTITION BY file ORDER BY page, r) - 1 AS row_no, CASE WHEN i = 1 THEN 'header' WHEN block THEN 'block' ELSE 'row' END AS kind, CASE WHEN block THEN 'BLOCK_HEADER:' ELSE '' END || array_to_string(cells, '|') AS cells FROM f WHERE r > 0 OR i = 1""")
def course_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a customer's pages as one, with its header once."""
    lines, words = _pages(spark, sf_dir)
    of = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("page"))
    rows = spread(ruled.cells(words, lines, ["page"]).join(of.hint("merge"), "page"), ["file"], table(spark, sf_dir, "lineitem").count())
    return ruled.courses(rows, "file", ["page", "table_no", "r"]).select("file", F.col("row_no").cast("long").alias("row_no"), "kind", F.array_join("cells", "|").alias("cells"))


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as programs, with sections of six concepts."""
    k, text = F.col("c_custkey"), lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    decision = text("## Quyết định số ", k % 40, "/QĐ-ĐHCT ngày 5 tháng ", k % 12 + 1, " năm 2021 của Hiệu trưởng về việc ban hành chương trình TRÌNH ĐỘ ", F.when(k % 3 == 0, "THẠC SĨ").otherwise("ĐẠI HỌC"))
    unit = F.when(k % 2 == 0, text("Đơn vị quản lý: Bộ môn ", F.col("c_mktsegment"), " - Khoa Y")).otherwise(text("Mã: 7\nĐơn vị quản lý: Khoa Số ", F.col("c_nationkey"), ", Trường Bách khoa\nHết"))
    aims = F.when(k % 2 == 0, text("### 1. Mục tiêu chung\nĐào tạo\n kỹ sư ", k, "\n### 2. Mục tiêu cụ thể\na. Có kiến thức ", k % 9, "; (PEO 1)\nb) Có kỹ năng, (PEO2)")).otherwise(text(" Đào tạo\nkỹ sư ", k, " "))
    jobs, study = text("- Kỹ sư ", F.col("c_mktsegment"), "\n- Giảng   viên\n+ Chuyên viên ", k % 7), text("Học tiếp\n- Tự học ", k % 5)
    cited = text("- Luật Giáo dục số 43/2019/QH", k % 15, " của Quốc hội ban hành năm 2019\n- ACM ", k % 20, " (https://acm.org/\n x).\n+ Chuẩn AUN: https://aun.org/", k % 3, ".")
    parts = {"QUYET_DINH": decision, "DON_VI": unit, "MUC_TIEU": aims, "VI_TRI_VIEC_LAM": jobs, "KHA_NANG_HOC_TAP": study, "THAM_KHAO": cited}
    at = F.explode(F.array(*(F.struct(F.lit(c).alias("concept"), t.alias("text")) for c, t in parts.items()))).alias("s")
    return table(spark, sf_dir, "customer").select(text("P", k).alias("program"), text("M", F.col("c_nationkey")).alias("major"), at).select("program", "major", "s.concept", "s.text")


PROGRAMS = """c AS (SELECT 'P' || c_custkey AS program, 'M' || c_nationkey AS major, c_custkey AS k, c_nationkey AS n, c_mktsegment AS seg FROM customer),
    f AS (SELECT program, 'VanBanPhapLy' AS type, (k % 40) || 'QDDHCT' AS id, 'Về việc ban hành chương trình TRÌNH ĐỘ ' || CASE WHEN k % 3 = 0 THEN 'THẠC SĨ' ELSE 'ĐẠI HỌC' END AS name, 'Quyết định' AS kind,
                 '05/' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '/2021' AS issued, 'Hiệu trưởng' AS agency, NULL AS link, 'DUOC_BAN_HANH_THEO' AS edge_type, program AS source FROM c
        UNION ALL SELECT program, 'TrinhDo', CASE WHEN k % 3 = 0 THEN 'THACSI' ELSE 'DAIHOC' END, CASE WHEN k % 3 = 0 THEN 'THẠC SĨ' ELSE 'ĐẠI HỌC' END, NULL, NULL, NULL, NULL, 'DAO_TAO_TRINH_DO', program FROM c
        UNION ALL SELECT program, CASE WHEN k % 2 = 0 THEN 'BoMon' ELSE 'Khoa' END, CASE WHEN k % 2 = 0 THEN seg ELSE 'So' || n END, CASE WHEN k % 2 = 0 THEN seg ELSE 'Số ' || n END, NULL, NULL, NULL, NULL, 'THUOC_VE', major FROM c
        UNION ALL SELECT program, 'MucTieuDaoTao', program || '_chung', 'Đào tạo kỹ sư ' || k, 'Chung', NULL, NULL, NULL, 'CO_MUC_TIEU_DAO_TAO', program FROM c
        UNION ALL SELECT program, 'MucTieuDaoTao', program || '_PEO' || i, CASE i WHEN 1 THEN 'Có kiến thức ' || (k % 9) ELSE 'Có kỹ năng' END, 'CuThe', NULL, NULL, NULL, 'CO_MUC_TIEU_DAO_TAO', program FROM c, unnest([1, 2]) AS u(i) WHERE k % 2 = 0
        UNION ALL SELECT program, 'ViTriViecLam', program || '_vtvl_' || i, ['Kỹ sư ' || seg, 'Giảng viên', 'Chuyên viên ' || (k % 7)][i], NULL, NULL, NULL, NULL, 'CO_CO_HOI_VIEC_LAM', program FROM c, unnest([1, 2, 3]) AS u(i)
        UNION ALL SELECT program, 'KhaNangHocTap', program || '_knht_' || i, ['Học tiếp', 'Tự học ' || (k % 5)][i], NULL, NULL, NULL, NULL, 'TAO_NEN_TANG', program FROM c, unnest([1, 2]) AS u(i)
        UNION ALL SELECT program, 'VanBanPhapLy', '432019QH' || (k % 15), 'Ban hành năm 2019', 'Luật', '', 'Quốc hội', NULL, 'TUAN_THU', program FROM c
        UNION ALL SELECT program, 'ChuanThamKhao', program || '_ctk_' || i, CASE i WHEN 1 THEN 'ACM ' || (k % 20) ELSE 'Chuẩn AUN' END, NULL, NULL, NULL, CASE i WHEN 1 THEN 'https://acm.org/x' ELSE 'https://aun.org/' || (k % 3) END, 'THAM_CHIEU', program FROM c, unnest([1, 2]) AS u(i))"""


@query(f"WITH {PROGRAMS} SELECT type, id, arg_min(name, program) AS name, arg_min(kind, program) AS kind, arg_min(issued, program) AS issued, arg_min(agency, program) AS agency, arg_min(link, program) AS link, count(DISTINCT program) AS programs FROM f GROUP BY type, id")
def program_nodes_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions, levels, units, objectives, jobs, further study and references of all programs, one node for each id."""
    return program_nodes.nodes(program_nodes.found(_programs(spark, sf_dir)))


@query(f"WITH {PROGRAMS} SELECT DISTINCT source AS src, edge_type AS type, id AS dst FROM f")
def program_edges_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges from programs and majors to them."""
    return program_nodes.edges(program_nodes.found(_programs(spark, sf_dir)))


GRAPH = """n AS (SELECT n_nationkey AS g, 0 AS place, 'nation:' || n_nationkey AS id, 'nation' AS label, n_name AS name, '' AS props FROM nation
        UNION ALL SELECT c_nationkey, 1 + c_custkey, 'customer:' || c_custkey, 'customer', c_name, 'segment=' || c_mktsegment FROM customer UNION ALL SELECT s_nationkey, 1000000000 + s_suppkey, 'supplier:' || s_suppkey, 'supplier', s_name, '' FROM supplier),
    e AS (SELECT g, 'nation:' || g AS src, id AS dst, CASE label WHEN 'customer' THEN 'HAS_CUSTOMER' ELSE 'HAS_SUPPLIER' END AS type FROM n WHERE label <> 'nation')"""


@query(f"""WITH {GRAPH}, l AS (SELECT g, 0 AS part, lpad(CAST(place AS VARCHAR), 12, '0') AS o, '- ' || label || ': ' || name || CASE WHEN props <> '' THEN ' (' || props || ')' ELSE '' END AS line FROM n
             UNION ALL SELECT e.g, 1, concat_ws(chr(1), e.src, e.type, e.dst), '- ' || a.name || ' -[' || e.type || ']-> ' || b.name FROM e JOIN n a ON a.g = e.g AND a.id = e.src JOIN n b ON b.g = e.g AND b.id = e.dst),
           t AS (SELECT g, '[GRAPH RESULT]' || chr(10) || 'Các nút liên quan:' || chr(10) || string_agg(line, chr(10) ORDER BY o) FILTER (part = 0) || coalesce(chr(10) || chr(10) || 'Các quan hệ chính:' || chr(10) || string_agg(line, chr(10) ORDER BY o) FILTER (part = 1), '') AS text FROM l GROUP BY g)
           SELECT g, md5(CASE WHEN length(text) > 12000 THEN left(text, 12000) || chr(10) || '...<truncated>' ELSE text END) AS digest, length(text) > 12000 AS cut FROM t""")
def graph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subgraph of every nation as the text that is given to a model, within 12,000 characters."""
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    row = lambda df, g, place, name, label, props: df.select(F.col(g).cast("long").alias("g"), place.cast("long").alias("place"), text(f"{label}:", F.col(name.replace("_name", f"_{ {'nation': 'nationkey', 'customer': 'custkey', 'supplier': 'suppkey'}[label] }"))).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"), props.alias("props"))
    nation = row(table(spark, sf_dir, "nation"), "n_nationkey", F.lit(0), "n_name", "nation", F.lit(""))
    customer = row(table(spark, sf_dir, "customer"), "c_nationkey", F.col("c_custkey") + 1, "c_name", "customer", text("segment=", F.col("c_mktsegment")))
    supplier = row(table(spark, sf_dir, "supplier"), "s_nationkey", F.col("s_suppkey") + 1_000_000_000, "s_name", "supplier", F.lit(""))
    nodes = nation.unionByName(customer).unionByName(supplier)
    edges = customer.unionByName(supplier).select("g", text("nation:", F.col("g")).alias("src"), F.concat(F.lit("HAS_"), F.upper("label")).alias("type"), F.col("id").alias("dst"))
    return graph.serialised(nodes, edges, "g").select("g", F.md5("text").alias("digest"), "cut")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS score FROM embeddings, q),
          t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s QUALIFY r <= 3)
          SELECT query_id, '- HocPhan [vector_' || (query_id % 3) || ']' || chr(10) || string_agg('  ' || r || '. score=' || printf('%.6f', score) || ' labels=["L' || label || '"] node={"id":"' || id || '"}', chr(10) ORDER BY r) AS text FROM t GROUP BY query_id""")
def vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of every one whose id is divisible by 20, as the text that is given to a model."""
    every = table(spark, sf_dir, "embeddings")
    found = vector.searched(every.where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id"), every, 3, id_col="vec_id").join(every.select("vec_id", "label"), "vec_id")
    props = F.create_map(F.lit("id"), F.col("vec_id").cast("string"), F.lit("embedding"), F.lit("none"))
    hit = F.struct("rank", "score", F.array(F.concat(F.lit("L"), F.col("label").cast("string"))).alias("labels"), props.alias("props"))
    at = found.select("query_id", "rank", hit.alias("h")).groupBy("query_id").agg(F.collect_list(F.struct("rank", "h.score", "h.labels", F.map_entries("h.props").alias("p"))).alias("hits"))
    hits = F.transform(F.array_sort("hits"), lambda x: F.struct(x["score"].alias("score"), x["labels"].alias("labels"), F.map_from_entries(x["p"]).alias("props")))
    return at.select("query_id", render.vector_lines(F.lit("HocPhan"), F.concat(F.lit("vector_"), (F.col("query_id") % 3).cast("string")), hits).alias("text"))
