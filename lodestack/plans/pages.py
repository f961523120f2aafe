"""Catalogue: blocks of pages, titles of documents, fields and plans of curricula, grades of runs, deleting of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import blocks, rects, vector
from lodestack.operators import curriculum, evaluate, ingest, pages
from lodestack.plans import views
from lodestack.plans.registry import query
from lodestack.plans.texts import BOXES
from lodestack.plans.views import SQL, table

FORMS = (
    "Số: 12/TB-ĐHCT\n2024\nV/v nghỉ Tết", "2024", "117\n 12 ", "Cần Thơ, ngày 3 tháng 5", "THÔNG BÁO\n(đính kèm)\nLịch nghỉ lễ", "31", "Danh sách có: 12 sinh viên", "iv xem trang bìa",
    "Lưu ý: đem theo thẻ", "- nộp đơn", "Về việc: nghỉ lễ 2/9", "1.2 Đối tượng", "PHÒNG ĐÀO TẠO", "và nộp đơn tại văn phòng.", " \n ", "Phụ lục 1\nbiểu mẫu",
)
ITEMS = f"""items0 AS (SELECT user_id AS doc, event_id AS pos, event_id // 8 AS page, event_id % 16 AS n, CAST(event_id * 37 % 100 AS DOUBLE) AS y0, CAST(event_id * 53 % 400 AS DOUBLE) AS x0 FROM events),
    items AS (SELECT doc, pos, page, x0, y0, x0 + 60 AS x1, y0 + 12 AS y1, [{', '.join("'" + f + "'" for f in FORMS)}][CASE WHEN doc % 3 = 0 THEN n WHEN n IN (0, 10) THEN 13 WHEN doc % 3 = 2 AND n = 4 THEN 15 ELSE n END + 1] AS text FROM items0)"""
LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
END = r"([^\p{L}\p{N}_]|$)"
KIND = rf"""CASE WHEN f IS NULL THEN 'doan_van' WHEN regexp_matches(f, '(?i)^(SỐ\s*:?\s*[\d/]|CẦN THƠ\s*,?\s*NGÀY{END})') THEN 'metadata'
    WHEN regexp_matches(f, '(?i)^(Danh\s+sách\s+có\s*:|(LƯU Ý|GHI CHÚ|CHÚ THÍCH)\s*:|\()') OR (y0 >= 90 AND regexp_matches(f, '(?i)^[ivxlcdm]+\s+\S')) THEN 'ghi_chu' WHEN regexp_matches(f, '^[-–—•+]') THEN 'bullet'
    WHEN regexp_matches(f, '(?i)^(V\s*/\s*v|Về\s+việc|THÔNG BÁO|QUYẾT ĐỊNH|QUY ĐỊNH|KẾ HOẠCH|HƯỚNG DẪN|BÁO CÁO|CÔNG VĂN|PHỤ LỤC|DANH SÁCH){END}') THEN 'tieu_de'
    WHEN regexp_matches(f, '(?i)^((\d+\.\d+(\.\d+)*\.?|\d+[.)])\s+\S|[IVXLCDM]+\.\s+\S|BƯỚC\s+\d)') OR (len(w) <= 240 AND regexp_matches(w, '\p{{L}}') AND NOT regexp_matches(w, '[^\P{{L}}\p{{Lu}}]')) THEN 'heading' ELSE 'doan_van' END"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items of pages of eight, a user's are a document; their texts take sixteen forms, some documents lack subjects or titles."""
    n, doc = F.col("event_id") % 16, F.col("user_id")
    form = F.when(doc % 3 == 0, n).when(n.isin(0, 10), 13).when((doc % 3 == 2) & (n == 4), 15).otherwise(n)
    y0, x0 = (F.col("event_id") * 37 % 100).cast("double"), (F.col("event_id") * 53 % 400).cast("double")
    return table(spark, sf_dir, "events").select(
        doc.alias("doc"), F.col("event_id").alias("pos"), F.floor(F.col("event_id") / 8).alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + 60).alias("x1"), (y0 + 12).alias("y1"),
        F.element_at(F.array(*map(F.lit, FORMS)), (form + 1).cast("int")).alias("text"),
    )


@query(f"""WITH {ITEMS}, every AS (SELECT 'item' AS origin, pos AS id, text, y0 FROM items UNION ALL SELECT 'document', doc_id, text, CAST(doc_id % 100 AS DOUBLE) FROM documents),
           l AS (SELECT *, {LINES} AS lines FROM every), w AS (SELECT origin, id, y0, lines[1] AS f, array_to_string(lines, chr(10)) AS w FROM l) SELECT origin, id, {KIND} AS kind FROM w""")
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every item and of every document's whole text, on pages 100 high."""
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 100).cast("double").alias("y0"))
    at = _items(spark, sf_dir).select(F.lit("item").alias("origin"), F.col("pos").alias("id"), "text", "y0").unionByName(d)
    return at.select("origin", "id", blocks.kind(F.col("text"), F.col("y0"), F.lit(100.0)).alias("kind"))


@query(rf"""WITH {ITEMS}, t AS (SELECT doc, pos, text, lead(text) OVER (PARTITION BY doc ORDER BY pos) AS next FROM items), k AS (SELECT *, trim(text, E' \n') AS a, trim(coalesce(next, ''), E' \n') AS b FROM t)
           SELECT doc, pos, regexp_matches(a, '[.!?]$') AS stops, regexp_matches(regexp_extract(b, '[A-Za-zÀ-ỹĐđ]'), '\p{{Ll}}') OR regexp_matches(b, '^[(\[{{"]') AS goes_on,
                  trim(regexp_replace(lower(a), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS title_key, a <> '' AND regexp_matches(a, '^(THÔNG BÁO|QUYẾT ĐỊNH|DANH SÁCH|PHỤ LỤC)( |\n|$)') AS starts FROM k""")
def line_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an item ends a sentence, the next of its document goes on with it, and it starts a document as a heading."""
    at = _items(spark, sf_dir).withColumn("next", F.lead("text").over(Window.partitionBy("doc").orderBy("pos")))
    t = F.col("text")
    starts = blocks.document_start(t, F.lit("heading"))
    return at.select("doc", "pos", blocks.ends_sentence(t, strong=True).alias("stops"), blocks.goes_on(F.col("next")).alias("goes_on"), blocks.comparison_key(t).alias("title_key"), starts.alias("starts"))


@query(f"""WITH {BOXES} SELECT page, l_linenumber, l_partkey, l_suppkey FROM words w WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page = w.page AND (w.x0 + w.x1) / 2 BETWEEN b.x0 - 1 AND b.x1 + 1 AND (w.y0 + w.y1) / 2 BETWEEN b.y0 - 1 AND b.y1 + 1
           AND greatest(least(w.x1, b.x1 + 1) - greatest(w.x0, b.x0 - 1), 0) * greatest(least(w.y1, b.y1 + 1) - greatest(w.y0, b.y0 - 1), 0) / ((w.x1 - w.x0) * (w.y1 - w.y0)) >= 0.9)""")
def items_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as words of their order's page, without those that lie wholly in its table."""
    d = lambda c: c.cast("double")
    p, s, o, c = F.col("l_partkey") % 500, F.col("l_suppkey") % 700, F.col("o_orderkey") % 600, F.col("o_custkey") % 400
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_partkey", "l_suppkey", d(p).alias("x0"), d(s).alias("y0"), d(p + 10 + F.col("l_quantity")).alias("x1"), d(s + 12).alias("y1"))
    boxes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), d(c).alias("x0"), d(o).alias("y0"), d(c + 150).alias("x1"), d(o + 120).alias("y1"))
    return pages.outside_tables(words, boxes, ["page"]).select("page", "l_linenumber", "l_partkey", "l_suppkey")


@query(rf"""WITH {ITEMS}, l AS (SELECT *, {LINES} AS lines FROM items), m AS (SELECT * FROM l WHERE len(list_filter(lines, lambda x: regexp_matches(x, '(?i)^SỐ\s*:?\s*[\d/]'))) > 0),
           o AS (SELECT * FROM l WHERE len(lines) BETWEEN 1 AND 3 AND len(list_filter(lines, lambda x: NOT regexp_full_match(x, '\d{{1,6}}'))) = 0),
           s AS (SELECT m.page, m.pos AS m, o.pos AS o, o.x0, o.y0, o.x1, o.y1, greatest(0, least(m.y1, o.y1) - greatest(m.y0, o.y0)) / 12 AS v, abs(m.y0 - o.y0) AS d FROM m JOIN o USING (page)),
           b AS (SELECT m, arg_max(o, v * 10 - d / 100) AS o FROM s WHERE v > 0 OR d <= 20 GROUP BY m), g AS (SELECT b.m, s.* EXCLUDE (m) FROM b JOIN s ON b.m = s.m AND b.o = s.o)
           SELECT i.page, i.pos, least(i.x0, coalesce(g.x0, i.x0)) AS x0, least(i.y0, coalesce(g.y0, i.y0)) AS y0, greatest(i.x1, coalesce(g.x1, i.x1)) AS x1, greatest(i.y1, coalesce(g.y1, i.y1)) AS y1, m.pos IS NOT NULL AS is_metadata,
                  CASE WHEN m.pos IS NULL THEN i.text ELSE replace(i.text, chr(10) || '2024', '') END AS text FROM items i LEFT JOIN m USING (pos) LEFT JOIN g ON g.m = i.pos WHERE i.pos NOT IN (SELECT o FROM g)""")
def overlay_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without the numbers laid over the number of a letter."""
    return pages.without_overlays(_items(spark, sf_dir), ["page"]).select("page", "pos", *rects.rect(), "is_metadata", "text")


@query(rf"""WITH {ITEMS}, u AS (SELECT doc, bool_or(text LIKE 'Số%') AS number, min(CASE WHEN text LIKE 'Về việc%' THEN pos END) AS subject, bool_or(text LIKE 'THÔNG BÁO%') AS notice FROM items GROUP BY doc)
           SELECT doc, CASE WHEN number THEN 'Về việc nghỉ Tết' WHEN subject IS NOT NULL THEN 'Về việc nghỉ lễ 2/9' WHEN notice THEN 'Lịch nghỉ lễ' WHEN doc % 2 = 0 THEN 'Về việc lịch thi ' || doc ELSE '' END AS title FROM u""")
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of documents by a line with a subject, a block of kind title, or the name of the file."""
    items = _items(spark, sf_dir).withColumn("kind", blocks.kind(F.col("text")))
    name = F.when(F.col("doc") % 2 == 0, F.concat(F.lit("in/TB_12_Thông báo_lịch  thi_"), "doc", F.lit(".signed.signed.pdf"))).otherwise("scan_7.pdf")
    return pages.titles(items, items.select("doc").distinct().withColumn("name", name))


PART_LINES = ("### 3.1 Kiến thức", "#### 3.1.1 Khối **đại cương**", "- Vận dụng toán (plo3);", "a. Đọc tài liệu", "Không tính", "4.1 Thái độ", "+ Tôn trọng (CDR12).", "* Tự học")
OUTCOME = f"""lines AS (SELECT p_brand AS program, p_partkey AS pos, p_size % 8 AS n FROM part)"""


@query(f"""WITH {OUTCOME}, c AS (SELECT *, max(CASE WHEN n IN (0, 5) THEN pos END) OVER w AS at1, max(CASE WHEN n = 1 THEN pos END) OVER w AS at2, max(CASE WHEN n IN (0, 5) THEN (pos, n) END) OVER w AS head,
             count(*) FILTER (n IN (3, 7)) OVER w AS i FROM lines WINDOW w AS (PARTITION BY program ORDER BY pos))
           SELECT program, pos, CASE n WHEN 2 THEN 'PLO3' WHEN 6 THEN 'CDR12' ELSE 'CDR_' || CASE WHEN i < 10 THEN '0' ELSE '' END || i END AS code, CASE n WHEN 2 THEN 'Vận dụng toán' WHEN 3 THEN 'Đọc tài liệu' WHEN 6 THEN 'Tôn trọng' ELSE 'Tự học' END AS content,
                  CASE WHEN at1 IS NULL THEN 'Chung' WHEN (SELECT p_size % 8 FROM part WHERE p_partkey = at1) = 0 THEN 'Kiến thức' ELSE 'Thái độ' END AS category, CASE WHEN at2 > coalesce(at1, -1) THEN 'Khối **đại cương' ELSE 'Chung' END AS subcategory FROM c WHERE n IN (2, 3, 6, 7)""")
def learning_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of their brand's learning outcomes, in one of eight forms."""
    line = F.element_at(F.array(*map(F.lit, PART_LINES)), (F.col("p_size") % 8 + 1).cast("int"))
    return curriculum.outcomes(table(spark, sf_dir, "part").select(F.col("p_brand").alias("program"), F.col("p_partkey").alias("pos"), line.alias("line")))


@query(f"""WITH c AS (SELECT c_custkey, c_custkey % 9 AS n, 2020 + c_custkey % 8 AS year FROM customer)
           SELECT c_custkey, ['MUC_TIEU', 'CHUAN_DAU_RA', 'VI_TRI_VIEC_LAM', 'KHA_NANG_HOC_TAP', 'KHUNG_CHUONG_TRINH', 'THAM_KHAO', 'THONG_TIN_CHUNG', 'UNKNOWN', 'MUC_TIEU'][n + 1] AS concept, 'M' || n || '_' || CASE WHEN n = 8 THEN 0 ELSE year - 1974 END || CASE WHEN n % 2 = 0 THEN '_CLC' ELSE '_STD' END AS program,
                  CAST(CASE WHEN n = 8 THEN 0 ELSE year - 1974 END AS INT) AS cohort, CASE WHEN n % 2 = 0 THEN 'Tiếng Anh' ELSE 'Tiếng Việt' END AS language, CASE WHEN n < 4 THEN CAST(150 + n AS VARCHAR) ELSE '0' END AS credits, CASE WHEN n < 4 THEN '4.5' ELSE '0' END AS years, CASE WHEN n % 3 = 0 THEN 'Kỹ sư' ELSE 'Unknown' END AS degree FROM c""")
def curriculum_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sections are about by their headers, and a program's fields from its text, one for each customer."""
    heads = ("1. Mục tiêu đào tạo", "CHUAN DAU RA", "Cơ hội nghề nghiệp", "Khả năng học tập sau ra trường", "Khung chương trình", "Căn cứ pháp lý", "Tổng quan", "Ghi chú", "Goals, việc làm")
    n, year = F.col("c_custkey") % 9, (F.lit(2020) + F.col("c_custkey") % 8).cast("string")
    full = F.concat(F.when(n % 2 == 0, "Chương trình Chất lượng cao ").otherwise("Chương trình "), F.when(n != 8, F.concat(F.lit("ban hành Năm "), year)).otherwise(""))
    body = F.concat(F.when(n < 4, F.concat(F.lit("Tổng cộng: "), (n + 150).cast("string"), F.lit(" TC\nThời gian đào tạo: 4,5 năm\n"))).otherwise(""), F.when(n % 3 == 0, "Danh hiệu: Kỹ sư \nHết").otherwise(""))
    f = curriculum.program_fields(F.concat(F.lit("M"), n.cast("string")), body, full)
    at = table(spark, sf_dir, "customer").select("c_custkey", curriculum.concept(F.element_at(F.array(*map(F.lit, heads)), (n + 1).cast("int"))).alias("concept"), f.alias("f"))
    return at.select("c_custkey", "concept", "f.program", "f.cohort", "f.language", "f.credits", "f.years", "f.degree")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'HocPhan' WHEN 1 THEN 'Nganh,Khoa' ELSE '' END AS anchors, CASE c_custkey % 4 WHEN 0 THEN 'GOM,CO' WHEN 1 THEN 'DAO_TAO' ELSE '' END AS relations, CAST(CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 2 END AS INT) AS max_depth,
          CAST(greatest(10, least(c_custkey, 120)) AS INT) AS max_paths, CASE WHEN c_custkey % 2 = 0 THEN 'list' ELSE 'summary' END AS shape, CAST(CASE WHEN c_custkey % 7 = 0 THEN 51 ELSE 40 + c_custkey % 12 END AS INT) AS cohort, CASE WHEN c_custkey % 6 = 0 THEN 'đại trà' ELSE 'CLC' END AS mode, c_custkey % 7 = 0 OR c_custkey % 6 = 0 AS used_default, CASE WHEN c_custkey % 2 = 0 THEN 'list' ELSE 'description' END AS query_type FROM customer""")
def graph_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans as a model writes them, made safe, and the filters of programs, one for each customer."""
    k, texts = F.col("c_custkey"), lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    anchors = F.when(k % 3 == 0, texts(" HocPhan ", "hocphan", "X"))
    relations = F.when(k % 4 == 0, texts(" gom", "CO", "GOM", "NO")).when(k % 4 == 2, texts("?"))
    depth = F.element_at(texts("0", "9", "two", "1", "2"), (k % 5 + 1).cast("int"))
    p = curriculum.plan(anchors, F.when(k % 3 == 1, texts("Nganh", "Khoa", "Nganh", "Lop")), relations, F.when(k % 4 == 1, texts("dao_tao")), depth, k.cast("string"), F.lit("50"), F.when(k % 2 == 0, " LIST ").otherwise("tree"))
    f = curriculum.program_filter(F.when(k % 7 != 0, F.concat(F.lit("K"), (k % 12 + 40).cast("string"), F.lit(" 9"))), F.when(k % 6 == 0, " ").otherwise(" CLC"))
    at = table(spark, sf_dir, "customer").select("c_custkey", p.alias("p"), f.alias("f"), curriculum.query_type(F.when(k % 2 == 0, "List ")).alias("query_type"))
    return at.select("c_custkey", F.array_join("p.anchors", ",").alias("anchors"), F.array_join("p.relations", ",").alias("relations"), "p.max_depth", "p.max_paths", "p.shape", "f.cohort", "f.mode", "f.used_default", "query_type")


@query("""SELECT c_custkey AS query_id, p_partkey AS id FROM customer JOIN part ON p_size = CASE WHEN c_custkey % 5 = 0 THEN 51 ELSE c_custkey % 50 END AND lower(p_brand) = 'brand#' || (c_custkey % 25 + 1)""")
def program_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as programs with their size as cohort and their brand as mode; customers as questions, some without a cohort."""
    k = F.col("c_custkey")
    f = curriculum.program_filter(F.when(k % 5 != 0, (k % 50).cast("string")), F.concat(F.lit(" BRAND#"), (k % 25 + 1).cast("string"), F.lit(" ")))
    asked = table(spark, sf_dir, "customer").select(k.alias("query_id"), f.alias("f")).select("query_id", "f.cohort", "f.mode")
    return curriculum.of_programs(asked, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("cohort"), F.col("p_brand").alias("mode")))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), o AS (SELECT o_custkey AS query_id, count(*) AS n FROM orders GROUP BY 1),
          thin AS (SELECT q.* FROM q LEFT JOIN o USING (query_id) WHERE coalesce(n, 0) < 12),
          s AS (SELECT query_id, vec_id AS id, label AS target, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS score FROM embeddings, thin),
          t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, target ORDER BY score DESC, id) AS r FROM t WHERE n <= 20), d AS (SELECT * FROM c WHERE r <= 3),
          e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_returnflag AS type FROM lineitem WHERE l_returnflag IN ('A', 'N')), e4 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY type, dst) AS i FROM e),
          x AS (SELECT query_id, src, dst, e4.type, row_number() OVER (PARTITION BY query_id ORDER BY i, src) AS j FROM (SELECT DISTINCT query_id, id AS src FROM d) JOIN e4 USING (src) WHERE i <= 4)
          SELECT query_id, -1 AS origin, id, coalesce(CAST(target AS BIGINT), -1) AS target, round(score, 6) AS score, '' AS type FROM d UNION ALL SELECT query_id, src, dst, -1, -2, type FROM x WHERE j <= 12""")
def curriculum_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 20 and whose customer has under twelve orders (the graph is thin): the best of its 20 nearest vectors by label, and one step from these, parts, to their suppliers."""
    every = table(spark, sf_dir, "embeddings")
    asked = every.where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    graphs = asked.join(orders, "query_id", "left").select("query_id", F.when(n >= 12, 2).otherwise(1).alias("n_nodes"), (n >= 12).cast("int").alias("n_edges"), n.alias("n_chars"))
    found = vector.searched(asked, every, 20, id_col="vec_id").withColumnRenamed("vec_id", "id").join(every.select(F.col("vec_id").alias("id"), F.col("label").alias("target")), "id")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("type"))
    out = curriculum.hybrid(graphs, found.select("query_id", "target", "id", "score"), edges, ("A", "N"))
    minus = lambda c, v: F.coalesce(c, F.lit(v))
    return out.select("query_id", minus(F.col("origin"), -1).alias("origin"), "id", minus(F.col("target").cast("long"), -1).alias("target"), F.round(minus(F.col("score"), -2.0), 6).alias("score"), minus(F.col("type"), "").alias("type"))


@query("""SELECT o_orderkey AS id, CAST(o_orderkey % 2 AS INT) AS final_hit, CAST(CASE WHEN o_custkey % 3 < 2 THEN o_custkey % 3 END AS INT) AS accurate,
          CASE WHEN o_custkey % 3 = 2 THEN CASE WHEN o_orderkey % 11 = 0 THEN 'RUNTIME_TIMEOUT' ELSE 'UNGRADED' END WHEN o_orderkey % 11 = 0 THEN 'RUNTIME_TIMEOUT' WHEN o_custkey % 3 = 1 THEN CASE o_orderkey % 2 WHEN 1 THEN 'OK' ELSE 'GOLD_AUDIT' END WHEN o_orderkey % 2 = 1 THEN 'GENERATION' ELSE 'EVIDENCE_MISS' END AS error_class,
          CASE WHEN o_orderstatus <> 'P' THEN o_shippriority + o_orderkey * 3 % 1000 END AS pos FROM (SELECT *, 0 AS o_shippriority FROM orders)""")
def manual_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a run after grades by hand, with their place among the cases; pending ones are no cases."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(k.alias("id"), (k % 2).cast("int").alias("final_hit"), F.lit(None).cast("int").alias("accurate"), F.when(k % 11 == 0, "RUNTIME_TIMEOUT").otherwise("UNGRADED").alias("error_class"))
    grades = o.select(k.alias("id"), F.when(F.col("o_custkey") % 3 < 2, F.col("o_custkey") % 3).cast("int").alias("grade"))
    cases = o.where("o_orderstatus <> 'P'").select(k.alias("id"), (k * 3 % 1000).alias("pos"))
    return evaluate.ordered(evaluate.graded(rows, grades), cases).select("id", "final_hit", "accurate", "error_class", "pos")


@query("""SELECT user_id AS run, CASE WHEN count(*) FILTER (user_id % 5 = 0 AND event_type = 'error') = 0 AND (user_id % 2 = 0 OR count(DISTINCT event_type = 'click') = 1) THEN CAST(CASE WHEN user_id % 2 = 0 OR max(event_type) <> 'click' OR min(event_type) <> 'click' THEN 6 ELSE 3 END AS INT) END AS top_k,
          CASE WHEN count(*) FILTER (user_id % 5 = 0 AND event_type = 'error') > 0 THEN 'invalid top_k' WHEN user_id % 2 = 1 AND count(DISTINCT event_type = 'click') = 2 THEN 'more than one top_k' END AS fault FROM events GROUP BY user_id""")
def stored_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of their user's run, some with a top_k that is none, some with two."""
    u, t = F.col("user_id"), F.col("event_type")
    k = F.when((u % 5 == 0) & (t == "error"), "six").when((u % 2 == 1) & (t == "click"), "3").otherwise("6")
    return evaluate.stored_k(table(spark, sf_dir, "events").select(u.alias("run"), k.alias("top_k")))


@query(f"""WITH {SQL['nodes']}, {SQL['edges']}, r AS (SELECT 'nation:' || n_nationkey AS root, n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'nation:none', -1),
           c AS (SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY k)
           SELECT root, CASE WHEN r.k < 0 THEN 0 ELSE 1 + coalesce(n, 0) END AS n, CAST((SELECT count(*) FROM nodes) - (SELECT sum(n + 1) FROM c WHERE k < 3) AS BIGINT) AS nodes_left FROM r LEFT JOIN c USING (k)""")
def delete_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nations' trees deleted, and one that is not there: nodes that go with each, nodes that are left."""
    roots = table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id")).unionByName(spark.createDataFrame([("nation:none",)], "id string"))
    nodes, _, counts = ingest.without_trees(views.nodes(spark, sf_dir), views.edges(spark, sf_dir), roots)
    left = F.broadcast(nodes.agg(F.count("*").alias("nodes_left")))  # one row
    return counts.join(left)
