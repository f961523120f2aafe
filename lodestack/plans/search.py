"""Catalogue: batches of vector searches, what questions name, the choice of tables, audits of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text, vector
from lodestack.operators import audit, tables
from lodestack.plans import views
from lodestack.plans.registry import query
from lodestack.plans.views import FOLD, SQL

Q, N, H = SQL["questions"], SQL["notices"], SQL["headed_rows"]


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
          r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score IS NOT NULL)
          SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 6""")
def vector_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six nearest of all vectors for each vector whose id is divisible by 20, the stated query set."""
    every = views.table(spark, sf_dir, "embeddings")
    asked = every.where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")
    found = vector.searched(asked, every, 6, id_col="vec_id")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {Q}, {H}, v AS (SELECT DISTINCT o_custkey AS conv_id, trim(cells[2]) AS value FROM headed_rows JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 4 = 1 AND trim(cells[2]) <> ''),
           f AS (SELECT conv_id, turn, {FOLD.format('question')} AS q FROM questions),
           r AS (SELECT conv_id, turn, value, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(value) DESC, value) AS i FROM f JOIN v USING (conv_id) WHERE contains(q, {FOLD.format('value')}))
           SELECT conv_id, turn, value AS major FROM r WHERE i = 1""")
def major_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a value of the columns of majors in their customer's orders."""
    asked = views.questions(spark, sf_dir)
    own = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("conv_id"))
    cells = views.headed_rows(spark, sf_dir).select("l_orderkey", F.explode(F.arrays_zip("headers", "cells")).alias("c"))
    majors = cells.where(F.contains(text.fold(F.col("c.headers")), F.lit("nganh"))).select("l_orderkey", F.col("c.cells").alias("value")).distinct()
    values = own.join(majors, "l_orderkey").join(asked.select("conv_id", "turn"), "conv_id").select("conv_id", "turn", "value")
    return tables.named_majors(asked, values, ["conv_id", "turn"])


@query(f"""WITH {Q}, l AS (SELECT conv_id, turn, lower(question) AS q, upper(trim(CASE turn % 3 WHEN 0 THEN ' co_the_song_hanh' WHEN 1 THEN 'GOM' END)) AS hint FROM questions)
           SELECT conv_id, turn, CASE WHEN regexp_matches(q, 'trực tuyến|online|e-learning') THEN 'quydinhdaotaotructuyen' WHEN regexp_matches(q, 'vừa học vừa làm|vhvl|tại chức|hệ vừa học') THEN 'QCDTVHVL' WHEN contains(q, 'từ xa') THEN 'QCDTTuXa' END AS regulation,
                  CASE WHEN hint = 'CO_THE_SONG_HANH' THEN hint ELSE concat_ws(',', CASE WHEN contains(q, 'tiên quyết') THEN 'YEU_CAU_TIEN_QUYET' END, CASE WHEN contains(q, 'song hành') THEN 'CO_THE_SONG_HANH' END) END AS relations FROM l""")
def named_regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regulation that a question names, and the relations of courses to follow, by hints or by its words."""
    hint = F.when(F.col("turn") % 3 == 0, " co_the_song_hanh").when(F.col("turn") % 3 == 1, "GOM")
    relations = F.array_join(text.course_relations(F.array(hint), F.col("question")), ",")
    return views.questions(spark, sf_dir).select("conv_id", "turn", text.regulation(F.col("question")).alias("regulation"), relations.alias("relations"))


@query("""WITH t AS (SELECT o_custkey AS seed, o_orderkey AS table_id, o_orderpriority = '1-URGENT' AS direct, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice / 1000) END AS score, CAST(month(o_orderdate) AS INT) AS seq FROM orders WHERE o_orderkey % 4 IN (0, 3)),
          b AS (SELECT *, bool_or(direct) OVER (PARTITION BY seed) AS any_direct, row_number() OVER (PARTITION BY seed ORDER BY score DESC NULLS LAST, seq, table_id) AS best FROM t)
          SELECT seed, table_id, CAST(row_number() OVER (PARTITION BY seed ORDER BY direct DESC, score DESC NULLS FIRST, seq, table_id) AS INT) AS position FROM b WHERE direct OR (NOT any_direct AND best = 1)""")
def relevant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of their customer, for a question with a course: urgent ones are direct, pending ones have no score."""
    o, kind = views.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    array = lambda *x: F.array(*map(F.lit, x))
    headers = F.when(kind == 0, array("Mã HP", "Khóa")).when(kind == 1, array("Mã sinh viên", "Ngành học")).when(kind == 2, array("Nội dung", "Khóa học")).otherwise(array("STT", "mã học phần"))
    at = o.select(
        F.col("o_custkey").alias("seed"), F.col("o_orderkey").alias("table_id"), (F.col("o_orderpriority") == "1-URGENT").alias("direct"),
        F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 1000)).alias("score"), F.lit("").alias("path"), F.month("o_orderdate").alias("seq"),
        F.exists(headers, lambda h: F.coalesce(tables.header_type(h) == "course", F.lit(False))).alias("eligible"),
    )
    return tables.relevant(at).select("seed", "table_id", "position")


@query(f"""WITH {N} SELECT id, concat_ws('; ', CASE WHEN semester IS NULL THEN 'thiếu mã văn bản' END, CASE WHEN id % 7 = 0 THEN 'thiếu ngày ban hành' END, CASE WHEN type = 'thong_bao_khac' THEN 'thiếu tiêu đề' END, CASE WHEN n.k IS NULL THEN 'không có nội dung' END) AS warnings,
           coalesce(n.n, 0) AS n_items FROM notices LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) n ON n.k = id""")
def document_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices that lack a semester, a date, a title or items, as documents without a code, a date, a title or content."""
    items = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("items"))
    n = views.notices(spark, sf_dir).join(items, F.col("id") == F.col("l_orderkey"), "left")
    at = n.select("id", F.col("semester").alias("code"), F.when(F.col("id") % 7 != 0, F.col("issued")).alias("issued"), F.when(F.col("type") != "thong_bao_khac", F.col("type")).alias("title"), "items")
    sizes = at.select("id", F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)).cast("long").alias("n_items"))
    found = audit.document_warnings(at).select("id", F.array_join("warnings", "; ").alias("warnings"))
    return found.join(sizes, "id")


@query("""SELECT doc_id FROM documents WHERE trim(text) <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE len(embedding) = (SELECT max(len(embedding)) FROM embeddings) AND label % 2 = 0)""")
def texts_to_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a stored vector of the right size; vectors with odd labels do not count as stored."""
    e = views.table(spark, sf_dir, "embeddings")
    size = e.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    stored = e.where("label % 2 = 0").select(F.col("vec_id").alias("doc_id"), "embedding")
    return audit.unembedded(views.table(spark, sf_dir, "documents").select("doc_id", "text"), stored, size, by="doc_id").select("doc_id")


@query()
def page_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents, repaired; the oracle's engine lacks the compatibility form, so that the tests hold it against plain Python."""
    at = views.table(spark, sf_dir, "documents").select("doc_id", text.repaired(F.col("text")).alias("t"))
    return at.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))
