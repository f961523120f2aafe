"""Catalogue: imports with their reports, texts for vectors and their coverage."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import embedding
from lodestack.plans import answers
from lodestack.plans.registry import query
from lodestack.plans.views import table
from lodestack.sources import imports
from lodestack.sources.shared import folder

FILES = """li AS (SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_orderkey % 50 = 7 THEN 'shared' || l_orderkey // 100 WHEN l_orderkey % 60 = 11 THEN 'R' || l_orderkey
           ELSE concat_ws('.', 'D' || l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) END AS id FROM lineitem),
    b AS (SELECT 0 AS b, o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 2 UNION ALL SELECT 1, o_orderkey FROM orders WHERE o_orderkey % 3 = 2 OR o_orderkey % 40 = 0 UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_orderkey % 90 = 1),
    ids AS (SELECT b, k, 'N' || k AS id, false AS is_row FROM b UNION ALL SELECT b, b.k, id, true FROM b JOIN li ON li.k = b.k WHERE b < 2 OR line <= 2),
    tw AS (SELECT b, id, count(*) AS n, count(DISTINCT k) AS files FROM ids GROUP BY b, id),
    own AS (SELECT DISTINCT ids.b, ids.k, CASE WHEN files > 1 THEN 2 ELSE 1 END AS fault, ids.id AS what FROM ids JOIN tw ON tw.b = ids.b AND tw.id = ids.id WHERE n > 1),
    s0 AS (SELECT b.k, min(CASE WHEN fault IS NOT NULL THEN (fault, what) END) AS f FROM b LEFT JOIN own ON own.b = 0 AND own.k = b.k WHERE b.b = 0 GROUP BY b.k),
    st0 AS (SELECT ids.id, ids.k FROM ids JOIN s0 ON s0.k = ids.k WHERE b = 0 AND f IS NULL),
    h1 AS (SELECT DISTINCT ids.k, 4 AS fault, ids.id AS what FROM ids JOIN st0 ON st0.id = ids.id WHERE b = 1),
    s1 AS (SELECT b.k, min(CASE WHEN fault IS NOT NULL THEN (fault, what) END) AS f FROM b LEFT JOIN (SELECT k, fault, what FROM own WHERE b = 1 UNION ALL SELECT * FROM h1) o ON o.k = b.k WHERE b.b = 1 GROUP BY b.k),
    st1 AS (SELECT * FROM st0 UNION ALL SELECT ids.id, ids.k FROM ids JOIN s1 ON s1.k = ids.k WHERE b = 1 AND f IS NULL),
    h2 AS (SELECT DISTINCT ids.k, 4 AS fault, ids.id AS what FROM ids JOIN st1 ON st1.id = ids.id AND st1.k <> ids.k WHERE b = 2),
    s2 AS (SELECT b.k, min(CASE WHEN fault IS NOT NULL THEN (fault, what) END) AS f FROM b LEFT JOIN (SELECT k, fault, what FROM own WHERE b = 2 UNION ALL SELECT * FROM h2) o ON o.k = b.k WHERE b.b = 2 GROUP BY b.k),
    s AS (SELECT 0 AS b, * FROM s0 UNION ALL SELECT 1, * FROM s1 UNION ALL SELECT 2, * FROM s2),
    c AS (SELECT s.b, s.k, f, count(*) FILTER (NOT is_row) AS n_notices, count(*) FILTER (is_row) AS n_rows FROM s JOIN ids ON ids.b = s.b AND ids.k = s.k GROUP BY ALL)"""


def _imports(spark: SparkSession, sf_dir: str) -> imports.Store:
    """Orders as files of a notice and its rows: two thirds, then the last third with some that are there, then some in another form."""
    store = imports.Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}", {"notices": "id", "rows": "notice_id"})
    k, li = F.col("l_orderkey"), table(spark, sf_dir, "lineitem")
    whole = F.concat_ws(".", F.concat(F.lit("D"), k), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))
    row_id = F.when(k % 50 == 7, F.concat(F.lit("shared"), F.floor(k / 100))).when(k % 60 == 11, F.concat(F.lit("R"), k)).otherwise(whole)
    rows = li.select(k.alias("k"), "l_linenumber", row_id.alias("id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    file, notice = F.concat(F.lit("f"), "k"), F.concat(F.lit("N"), "k")
    for some, lines, replace in ((F.col("k") % 3 != 2, F.lit(True), False), ((F.col("k") % 3 == 2) | (F.col("k") % 40 == 0), F.lit(True), False), (F.col("k") % 90 == 1, F.col("l_linenumber") <= 2, True)):
        notices = orders.where(some).select(file.alias("file"), notice.alias("id"), F.col("o_orderpriority").alias("type"))
        parts = {"notices": notices, "rows": rows.where(some & lines).select(file.alias("file"), "id", notice.alias("notice_id"), "l_linenumber")}
        imports.imported(store, parts, notices.select("file", F.col("id").alias("key")), replace)
    return store


@query(f"""WITH {FILES} SELECT CAST(b AS BIGINT) AS commit, 'f' || k AS file, CASE WHEN f IS NULL THEN 'imported' ELSE 'failed' END AS status, ['id twice in the file: ', 'id in two files: ', 'key of two files: ', 'id is stored: '][f[1]] || f[2] AS error,
           CASE WHEN f IS NULL THEN n_notices ELSE 0 END AS notices, CASE WHEN f IS NULL THEN n_rows ELSE 0 END AS rows FROM c""")
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of three imports, by file."""
    return _imports(spark, sf_dir).report().select("commit", "file", "status", "error", "notices", "rows")


@query(f"""WITH {FILES}, last AS (SELECT k, max(b) AS b FROM s WHERE f IS NULL GROUP BY k) SELECT ids.id, 'N' || ids.k AS notice_id, count(*) AS n FROM ids JOIN last ON last.k = ids.k AND last.b = ids.b WHERE is_row GROUP BY ALL""")
def imported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a store has after three imports."""
    return _imports(spark, sf_dir).read("rows").groupBy("id", "notice_id").agg(F.count("*").alias("n"))


def counted(texts: list[str]) -> np.ndarray:
    """A stand-in for a model: lengths and counts of two characters."""
    return np.array([[len(t), t.count("e"), t.count(" "), 1.0] for t in texts])


LEFT = """m AS (SELECT doc_id AS id, lang, text FROM documents WHERE trim(text) <> '' AND doc_id NOT IN (SELECT 2 * vec_id FROM embeddings)),
          v AS (SELECT id, lang, text, [length(text), length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, ' ', '')), 1]::DOUBLE[] AS v FROM m)"""


@query(f"WITH {LEFT} SELECT id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS embedding FROM v")
def embedded_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of whole documents that have none, by a function handed in; every second id has a stored one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    stored = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 2).alias("id"), "embedding")
    at = embedding.embedded(embedding.missing(docs, stored), counted, 4)
    return at.select("id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query("""SELECT lang, count(*) AS n, count(*) FILTER (trim(text) <> '') AS with_text, count(e.embedding) AS embedded, count(DISTINCT len(e.embedding)) AS sizes
          FROM documents LEFT JOIN embeddings e ON e.vec_id * 2 = doc_id GROUP BY lang""")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each language have a vector."""
    stored = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 2).alias("id"), "embedding")
    return embedding.coverage(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), stored, "lang")


@query(f"""WITH {answers.MODEL} SELECT notice_id, id, 'section' AS label, md5(text) AS digest FROM se WHERE trim(text) <> ''
           UNION ALL SELECT DISTINCT ro.notice_id, ro.id, 'row', md5(CAST(CAST(l_quantity AS INT) AS VARCHAR)) FROM ro JOIN lineitem ON ro.id = concat_ws('.', 'D' || l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS INT) AS VARCHAR))""")
def notice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections and rows below every notice, with the digests of their texts."""
    m = answers.model(spark, sf_dir)
    at = embedding.notice_texts(m.sections, m.tables, m.rows, m.notices)
    return at.select("notice_id", "id", "label", F.md5("text").alias("digest"))
