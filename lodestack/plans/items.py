"""Catalogue: documents as items, regulations, curricula, cleaning, provenance of reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import rects, text
from lodestack.operators import cleaning, curriculum, docs, regulations
from lodestack.plans import building
from lodestack.plans.registry import query
from lodestack.plans.views import SQL, table
from lodestack.sources.shared import spread

REG = """reg AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS INT) AS pos, o_orderkey % 23 = 0 AS chap, o_orderkey % 23 > 0 AND o_orderkey % 4 = 0 AS art,
        o_orderkey % 23 > 0 AND o_orderkey % 4 = 1 AS cla, o_orderkey % 23 > 0 AND o_orderkey % 4 = 2 AS poi, o_orderkey FROM orders),
    r1 AS (SELECT *, max(CASE WHEN chap THEN pos END) OVER w AS last_chapter, sum(CASE WHEN chap OR art THEN 1 ELSE 0 END) OVER w AS s FROM reg WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    r2 AS (SELECT *, first_value(art) OVER w AS headed, first_value(o_orderkey) OVER w AS head, sum(CASE WHEN (cla OR poi) THEN 1 ELSE 0 END) OVER w AS begun, sum(CASE WHEN cla THEN 1 ELSE 0 END) OVER w AS c FROM r1 WINDOW w AS (PARTITION BY doc_id, s ORDER BY pos)),
    r3 AS (SELECT *, CASE WHEN c > 0 THEN sum(CASE WHEN poi AND c > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, s, c ORDER BY pos) ELSE 0 END AS p,
               CASE WHEN art THEN 'title ' || o_orderkey WHEN cla THEN 'clause ' || o_orderkey WHEN poi AND c > 0 THEN 'point ' || o_orderkey WHEN poi THEN 'b) point ' || o_orderkey ELSE 'text ' || o_orderkey END AS body FROM r2 WHERE headed),
    parts AS (SELECT doc_id, min(pos) AS pos, any_value(CAST(head % 50 + 1 AS VARCHAR)) AS article, any_value(c) AS c, any_value(p) AS p, string_agg(body, ' ' ORDER BY pos) AS text FROM r3 GROUP BY doc_id, s, c, p)"""


def regulation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as lines of a regulation: chapters, articles, clauses, points and plain text."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    line = (
        F.when(k % 23 == 0, "CHƯƠNG II").when(k % 4 == 0, F.concat(F.lit("Điều "), (k % 50 + 1).cast("string"), F.lit(". title "), s))
        .when(k % 4 == 1, F.concat((k % 9 + 1).cast("string"), F.lit(". clause "), s)).when(k % 4 == 2, F.concat(F.lit("b) point "), s)).otherwise(F.concat(F.lit("text "), s))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.cast("int").alias("pos"), line.alias("line"))


@query(f"""WITH {REG} SELECT doc_id, pos, article, CASE WHEN p > 0 THEN 'point' WHEN c > 0 THEN 'clause' ELSE 'article' END AS level, text FROM parts""")
def regulation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regulations.parts(regulation_lines(spark, sf_dir)).select("doc_id", "pos", "article", "level", "text")


@query(f"""WITH {REG}, n AS (SELECT doc_id, count(DISTINCT (s, c, p)) + CAST(max(CASE WHEN last_chapter IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS below, count(DISTINCT CASE WHEN c = 0 AND p = 0 THEN s END) AS n_articles FROM r3 GROUP BY doc_id)
           SELECT doc_id, below + 1 AS n_nodes, below AS n_edges, n_articles FROM n""")
def regulation_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, edges and articles of each regulation as a graph."""
    return regulations.sizes(regulations.parts(regulation_lines(spark, sf_dir)))


def _article_context(tree: DataFrame, asked: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    asked = asked.select("doc_id", "article").distinct()
    asked = asked.select(F.struct("doc_id", "article").alias("query"), "doc_id", F.lit("article").alias("kind"), none.alias("chapter"), "article", none.alias("clause"), none.alias("point"))
    return regulations.looked_up(tree, asked).select("query.doc_id", "query.article", "context")


CONTEXTS = f"""WITH {REG} SELECT doc_id, article, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS context FROM parts GROUP BY doc_id, article"""


@query(CONTEXTS)
def article_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article of every regulation, asked for with all below it."""
    tree = regulations.parts(regulation_lines(spark, sf_dir))
    return _article_context(tree, tree)


COURSE = """course AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem),
    k AS (SELECT *, l_partkey % 11 = 0 AS header, l_partkey % 11 = 1 AS summary, l_partkey % 11 IN (2, 3) AS digits, l_partkey % 11 IN (4, 5) AS req, l_partkey % 11 IN (5, 6, 7) AS grp FROM course),
    b AS (SELECT *, last_value(CASE WHEN header THEN 'Khối ' || l_suppkey END IGNORE NULLS) OVER w AS block, sum(CASE WHEN header OR summary OR digits THEN 1 ELSE 0 END) OVER w AS s FROM k WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos)),
    q AS (SELECT *, last_value(CASE WHEN req THEN '10 ' || l_linenumber END IGNORE NULLS) OVER (PARTITION BY l_orderkey, s ORDER BY pos) AS requirement FROM b),
    g AS (SELECT *, last_value(CASE WHEN grp AND requirement IS NOT NULL THEN 'AV' || l_linenumber END IGNORE NULLS) OVER (PARTITION BY l_orderkey, s ORDER BY pos) AS grp_name FROM q)"""


def course_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's line items as a course table with headers, summaries, required and elective rows."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    k, line = F.col("l_partkey") % 11, F.col("l_linenumber").cast("string")
    required = F.when(k.isin(2, 3), "3").when(k.isin(5, 6, 7), F.concat(F.lit("AV"), line)).otherwise("")
    elective = F.when(k.isin(4, 5), F.concat(F.lit("10 "), line)).otherwise("")
    code = F.concat(F.lit("CT"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"))
    row = F.array(line, code, F.lit("name"), F.lit("3"), required, elective)
    cells = F.when(k == 0, F.array(F.concat(F.lit("BLOCK_HEADER: Khối "), F.col("l_suppkey").cast("string")))).when(k == 1, F.array(F.lit("Cộng: 14 TC (Bắt buộc: 4 TC; Tự chọn: 10 TC)"))).otherwise(row)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return spread(li, ["l_orderkey"], li.count()).select(F.col("l_orderkey").alias("program"), F.row_number().over(w).alias("pos"), cells.alias("cells"))


@query(f"""WITH {COURSE} SELECT l_orderkey AS program, CAST(pos AS INT) AS pos, block, requirement, grp_name AS "group", 'CT' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') AS code FROM g WHERE NOT header AND NOT summary""")
def course_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = curriculum.course_rows(course_table(spark, sf_dir)).where("kind = 'row'")
    return at.select("program", "pos", "block", "requirement", "group", "code")


@query(f"""WITH {COURSE} SELECT l_orderkey AS program, coalesce(CASE WHEN grp_name IS NOT NULL THEN concat_ws('/', block, requirement, grp_name) WHEN requirement IS NOT NULL THEN concat_ws('/', block, requirement) ELSE block END, '-') AS parent,
           count(*) AS n_courses, bool_and(requirement IS NULL) AS required FROM g WHERE NOT header AND NOT summary GROUP BY ALL""")
def course_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curriculum.courses(curriculum.course_rows(course_table(spark, sf_dir)))
    return found.groupBy("program", F.coalesce("parent", F.lit("-")).alias("parent")).agg(F.count("*").alias("n_courses"), F.bool_and("required").alias("required"))


@query(f"""WITH {COURSE} SELECT DISTINCT l_orderkey AS program, block, 14 AS total, 4 AS required, 10 AS elective FROM g WHERE summary AND block IS NOT NULL""")
def block_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.block_credits(curriculum.course_rows(course_table(spark, sf_dir)))


@query("""WITH t AS (SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 2 AS sig, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS title, o_orderkey FROM orders),
          j AS (SELECT *, CASE WHEN sig = lag(sig) OVER w AND (title IS NULL OR title = lag(title) OVER w) THEN 0 ELSE 1 END AS starts FROM t WINDOW w AS (PARTITION BY file ORDER BY page)),
          i AS (SELECT *, sum(starts) OVER (PARTITION BY file ORDER BY page) AS island FROM j)
          SELECT file, CAST(min(page) AS INT) AS page, arg_min(coalesce(title, '-'), page) AS title, count(*) AS pages, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY page) AS cells FROM i GROUP BY file, island""")
def table_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as tables on consecutive pages with one of two headers and sometimes a title."""
    from pyspark.sql import Window

    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    headers = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("Mã"), F.lit("Tên "))).otherwise(F.array(F.lit("Mã")))
    at = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), page.alias("page"), F.lit(0).alias("pos"), headers.alias("headers"), F.array(F.array(F.col("o_orderkey").cast("string"))).alias("rows"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).alias("title"))
    out = cleaning.continued_tables(at)
    return out.select("file", "page", F.coalesce("title", F.lit("-")).alias("title"), "pages", F.array_join(F.transform("rows", lambda r: F.get(r, F.lit(0))), ",").alias("cells"))


LETTER = """letter AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS INT) AS pos, o_orderkey % 12 AS kind, o_orderkey FROM orders),
    l1 AS (SELECT *, max(CASE WHEN kind = 9 AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END) OVER w AS footer FROM letter WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    l2 AS (SELECT *, coalesce(last_value(CASE WHEN kind = 1 THEN 1 WHEN kind IN (3, 4, 5) THEN 0 END IGNORE NULLS) OVER w, 0) AS recipient FROM l1 WHERE footer = 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    l3 AS (SELECT *, max(CASE WHEN kind = 7 THEN 1 ELSE 0 END) OVER w AS signed FROM l2 WHERE kind = 1 OR recipient = 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""


@query(f"""WITH {LETTER} SELECT doc_id, pos FROM l3 WHERE kind NOT IN (1, 6, 7, 10, 11) AND NOT (kind = 8 AND signed = 1)""")
def letter_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as lines of letters: recipients, long and short lines, agencies, signatures, names, footers."""
    k = F.col("o_orderkey") % 12
    long = F.concat(F.lit("đoạn nội dung dài hơn ba mươi lăm ký tự số "), F.col("o_orderkey").cast("string"))
    line = F.when(k == 1, "Kính gửi: các đơn vị").when(k == 2, "- Khoa Một").when(k.isin(3, 4, 5), long).when(k == 6, "TRƯỜNG ĐẠI HỌC").when(k == 7, "HIỆU TRƯỞNG").when(k == 8, "Nguyễn Văn An").when((k == 9) & (F.col("o_orderkey") % 5 == 0), "Nơi nhận:").when(k == 10, "BỘ GIÁO DỤC VÀ ĐÀO TẠO").when(k == 11, "ĐẠI HỌC CẦN THƠ ĐỘC LẬP - TỰ DO - HẠNH PHÚC").otherwise("dòng ngắn")
    at = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("int").alias("pos"), line.alias("line"))
    return cleaning.content_lines(at, ["doc_id"]).select("doc_id", "pos")


@query("""WITH l AS (SELECT l_orderkey AS page, l_suppkey % 3 AS block, l_linenumber AS line, string_agg('w' || l_partkey, ' ' ORDER BY l_partkey, l_suppkey) AS t, min(l_partkey) AS x0, min(l_suppkey) AS y0, max(l_partkey + 5) AS x1, max(l_suppkey + 9) AS y1 FROM lineitem GROUP BY ALL)
          SELECT page, block, string_agg(t, chr(10) ORDER BY line) AS text, CAST(min(x0) AS DOUBLE) AS x0, CAST(min(y0) AS DOUBLE) AS y0, CAST(max(x1) AS DOUBLE) AS x1, CAST(max(y1) AS DOUBLE) AS y1,
                 CAST(row_number() OVER (PARTITION BY page ORDER BY min(y0), min(x0), block) AS INT) AS place FROM l GROUP BY page, block""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as words: lines of blocks of pages, with rectangles and places."""
    d = lambda c: c.cast("double")
    words = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 3).alias("block"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("word_no"), d(F.col("l_suppkey")).alias("_s"),
        F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), d(F.col("l_partkey")).alias("x0"), d(F.col("l_suppkey")).alias("y0"), d(F.col("l_partkey") + 5).alias("x1"), d(F.col("l_suppkey") + 9).alias("y1"),
    )
    return docs.reading_order(words.drop("_s"), ["page"])


@query("""SELECT o_orderkey FROM orders WHERE o_custkey % 1000 < 1000 AND o_orderkey % 2 = 0 AND (o_orderkey % 842 + 10 <= 842 * 0.08 OR o_orderkey % 842 >= 842 * 0.90) AND abs(o_custkey % 595 + 5 - 595 / 2.0) <= 595 * 0.08""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text items of a page of 595 by 842; the odd ones are no numbers."""
    d = lambda c: c.cast("double")
    x, y = d(F.col("o_custkey") % 595), d(F.col("o_orderkey") % 842)
    label = F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 1000).cast("string")).otherwise("trang")
    at = table(spark, sf_dir, "orders").select("o_orderkey", label.alias("t"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 10).alias("y1"))
    return at.where(rects.page_number(F.col("t"), rects.rect(), F.lit(595.0), F.lit(842.0))).select("o_orderkey")


@query("""SELECT p_partkey, CAST(p_partkey % 90 + 1 AS VARCHAR) AS article, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS clause, CASE WHEN p_size % 3 = 2 THEN 'c' ELSE '' END AS point FROM part
          UNION ALL SELECT p_partkey, CAST(p_size AS VARCHAR), '2', 'b' FROM part WHERE p_partkey % 4 = 0""")
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sentences of regulations that refer to one or two other places."""
    size = F.col("p_size").cast("string")
    first = F.concat(F.lit("Xem Điều "), (F.col("p_partkey") % 90 + 1).cast("string"), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit(" Khoản "), size)).otherwise(""), F.when(F.col("p_size") % 3 == 2, " Điểm c").otherwise(""))
    sentence = F.concat(first, F.lit(" và các quy định"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("; theo điểm b khoản 2 Điều "), size)).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(text.cross_references(sentence)))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
          SELECT conv_id, string_agg(CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'user' END || ': ' || text, chr(10) ORDER BY turn) AS history FROM r WHERE r <= 8 AND trim(text) <> '' GROUP BY 1""")
def history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return building.last_turns(table(spark, sf_dir, "conversations"))


@query(f"""WITH {SQL['edges']}, {SQL['nodes']} SELECT s.label || ' ' || s.name AS source, e.type, t.label || ' ' || t.name AS target FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes t ON t.id = e.dst ORDER BY e.src, e.type, e.dst LIMIT 5""")
def edge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five triples in order: edges are cut before they meet their nodes."""
    from lodestack.plans import views

    few = views.edges(spark, sf_dir).orderBy("src", "type", "dst").limit(5)
    n = views.nodes(spark, sf_dir)
    name = F.concat_ws(" ", "label", "name")
    return few.join(n.select(F.col("id").alias("src"), name.alias("source")), "src").join(n.select(F.col("id").alias("dst"), name.alias("target")), "dst").select("source", "type", "target")
