"""Catalogue: scopes, tables, vectors, ranking, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import vector
from lodestack.operators import evaluate, rank, scope, tables
from lodestack.plans import views
from lodestack.plans.registry import query
from lodestack.plans.views import SQL

N, H = SQL["notices"], SQL["headed_rows"]
#: Cosine with the vector of id 0, in SQL.
SCORES = """scores AS (SELECT e.vec_id, e.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
            FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector as the question's; it stands in for an embedding model."""
    return views.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.scored(views.table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir)).select("vec_id", "label", "score")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"""WITH {N} SELECT * FROM notices WHERE type <> 'thong_bao_khac' AND semester = 2 AND (year = 1997 OR school_start = 1997 OR school_end = 1997)""")
def temporal_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.in_time(views.notices(spark, sf_dir), year=1997, semester=2)


@query(f"""WITH {N}, m AS (SELECT *, max(school_end) OVER (PARTITION BY type) AS e, max(year) OVER (PARTITION BY type) AS y FROM notices WHERE type <> 'thong_bao_khac')
           SELECT id, type, issued, year, school_start, school_end, semester FROM m WHERE CASE WHEN e IS NOT NULL THEN school_end = e ELSE year = y END""")
def latest_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.latest(views.notices(spark, sf_dir))


@query(f"""WITH {H} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(cells, '|') AS row_text FROM headed_rows
           WHERE (l_orderkey % 4 = 0 AND upper(cells[1]) = 'CT019' AND regexp_extract(cells[2], '([0-9][0-9])', 1) = '50')
              OR (l_orderkey % 4 = 2 AND len(cells) = 2 AND regexp_extract(cells[2], '([0-9][0-9])', 1) = '50')
              OR (l_orderkey % 4 = 3 AND len(cells) = 2 AND upper(cells[2]) = 'CT019')""")
def exact_cell_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.matching_rows(views.headed_rows(spark, sf_dir), {"course": "ct019", "cohort": "K50"})
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("cells", "|").alias("row_text"))


@query(f"""WITH {H}, h AS (SELECT unnest(headers) AS header FROM headed_rows), f AS (SELECT header, {views.FOLD.format('header')} AS x FROM h)
           SELECT header, CASE WHEN x LIKE '%ma hp%' OR x LIKE '%ma hoc phan%' THEN 'course' WHEN x LIKE '%ma sv%' OR x LIKE '%ma sinh vien%' THEN 'student'
                  WHEN x IN ('khoa', 'khoa hoc') THEN 'cohort' WHEN x LIKE '%nganh%' THEN 'major' END AS kind, count(*) AS n FROM f GROUP BY ALL""")
def header_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = views.headed_rows(spark, sf_dir).select(F.explode("headers").alias("header")).groupBy("header").agg(F.count("*").alias("n"))
    return at.select("header", tables.header_type(F.col("header")).alias("kind"), "n")


@query(f"""WITH {H}, c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, unnest(range(1, len(cells) + 1)) AS k, headers, cells FROM headed_rows)
           SELECT headers[k] AS header, count(*) AS n, count(DISTINCT cells[k]) AS n_values FROM c GROUP BY 1""")
def cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells(views.headed_rows(spark, sf_dir), ["l_orderkey"]).groupBy("header").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query(f"WITH {SCORES} SELECT vec_id, label, round(score, 6) AS score FROM scores ORDER BY scores.score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vector.top_k(scores(spark, sf_dir), 10, id_col="vec_id"), "score")


PER_LABEL = f"{SCORES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM scores)"


@query(f"WITH {PER_LABEL} SELECT vec_id, label, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 3")
def vector_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vector.top_k(scores(spark, sf_dir), 3, ["label"], id_col="vec_id"), "score")


@query(f"""WITH {SCORES}, d AS (SELECT s.vec_id AS id, s.label, s.score, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS tab FROM scores s JOIN documents ON vec_id = doc_id),
           r AS (SELECT *, row_number() OVER (PARTITION BY label, tab ORDER BY score DESC, id) AS r FROM d)
           SELECT id, label, tab, round(score, 6) AS score FROM r WHERE tab = '' OR r = 1""")
def representative_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source")).alias("tab"))
    rows = scores(spark, sf_dir).withColumnRenamed("vec_id", "id").join(docs, "id")
    return rounded(scope.representatives(rows, ["label", "tab"]), "score")


CANDIDATES = f"""{PER_LABEL}, cand AS (
        SELECT 'd' || label % 3 AS domain, vec_id AS id, 'vector' AS source, score, vec_id AS seq, label FROM ranked WHERE rank <= 8
        UNION ALL SELECT 'd' || label % 3, vec_id, 'exact', score * 0.5, 1000000 + vec_id, label FROM scores WHERE vec_id % 13 = 0
        UNION ALL SELECT 'd' || label % 3, vec_id, 'vector', score * 0.9, 2000000 + vec_id, label FROM ranked WHERE rank <= 4),
    merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, id ORDER BY source = 'exact' DESC, score DESC, seq) AS r FROM cand) WHERE r = 1)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of candidates in order: the best of each label, every thirteenth as an exact match, the best few again with lower scores."""
    s = scores(spark, sf_dir)
    best = vector.top_k(s, 8, ["label"], id_col="vec_id")

    def group(df: DataFrame, source: str, factor: float, first: int) -> DataFrame:
        return df.select(F.concat(F.lit("d"), F.col("label") % 3).alias("domain"), F.col("vec_id").alias("id"), F.lit(source).alias("source"), (F.col("score") * factor).alias("score"), (F.col("vec_id") + first).alias("seq"), "label")

    return group(best, "vector", 1.0, 0).unionByName(group(s.where("vec_id % 13 = 0"), "exact", 0.5, 1_000_000)).unionByName(group(best.where("rank <= 4"), "vector", 0.9, 2_000_000))


@query(f"WITH {CANDIDATES} SELECT domain, id, source, round(score, 6) AS score, seq, label FROM merged")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rank.merged(candidates(spark, sf_dir)), "score")


@query(f"WITH {CANDIDATES} SELECT domain, id, source, round(score, 6) AS score, seq, label FROM merged ORDER BY source = 'exact' DESC, merged.score DESC, seq LIMIT 12")
def pinned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rank.pinned(rank.merged(candidates(spark, sf_dir)), 12), "score")


TYPED = f"""{CANDIDATES}, {N}, typed AS (
        SELECT c.id, CASE WHEN c.id % 5 = 0 THEN '' ELSE n.type END AS type, c.score, c.seq, n.issued, n.year, n.school_start, n.school_end, n.semester
        FROM merged c JOIN notices n ON n.id = c.id WHERE c.source = 'vector'),
    keyed AS (SELECT *, coalesce(school_end, year) AS k1, coalesce(school_start, 0) AS k2, coalesce(semester, 0) AS k3 FROM typed),
    placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS place, row_number() OVER (PARTITION BY type ORDER BY k1 DESC, k2 DESC, k3 DESC, issued DESC, score DESC, id) AS newest,
                      row_number() OVER (PARTITION BY type ORDER BY score DESC, seq) AS slot FROM keyed),
    final AS (SELECT a.*, CASE WHEN a.type = '' THEN a.place ELSE b.place END AS position FROM placed a JOIN placed b ON a.type = b.type AND a.newest = b.slot)"""


def reranked(spark: SparkSession, sf_dir: str, k: int | None = None) -> DataFrame:
    """Vector candidates joined with the notices of their ids; every fifth has no type."""
    at = rank.merged(candidates(spark, sf_dir)).where("source = 'vector'").select("id", "score", "seq")
    at = at.join(views.notices(spark, sf_dir), "id").withColumn("type", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("type")))
    return rank.reranked(at, scope.recency(), k)


@query(f"WITH {TYPED} SELECT id, type, round(score, 6) AS score, issued, position FROM final")
def rerank_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reranked(spark, sf_dir).select("id", "type", "score", "issued", F.col("position").cast("long").alias("position")), "score")


@query(f"""WITH {TYPED}, b AS (SELECT position, coalesce(lang || ': ' || d.text, '') AS block FROM final f LEFT JOIN documents d ON d.doc_id = f.id WHERE position <= 6),
           u AS (SELECT *, coalesce(sum(length(block) + 2) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
           c AS (SELECT *, 12000 - before AS room, length(block) <= 12000 - before AS whole FROM u WHERE 12000 - before > 0),
           l AS (SELECT *, regexp_extract(block[1:room + 1], '^(.*)\\n', 1, 's') AS cut FROM c), m AS (SELECT *, concat_ws(chr(10), nullif(cut, ''), '[Context THONG_BAO đã được giới hạn]') AS told FROM l),
           t AS (SELECT *, CASE WHEN whole THEN block WHEN length(told) <= room THEN told ELSE cut END AS fitted FROM m)
           SELECT position, whole, length(fitted) AS n_chars, md5(fitted) AS digest FROM t WHERE whole OR fitted <> ''""")
def notification_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: candidates per label, merged, re-ranked, the first six with their texts in 12,000 characters."""
    top = reranked(spark, sf_dir, 6)
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(": ", "lang", "text").alias("block"))
    at = top.join(docs, "id", "left").withColumn("block", F.coalesce("block", F.lit(""))).withColumn("one", F.lit(1))
    fitted = rank.within_budget(at, 12_000, ["one"], ["position"], mark=rank.CUT)
    return fitted.select(F.col("position").cast("long").alias("position"), "whole", F.length("fitted").cast("long").alias("n_chars"), F.md5("fitted").alias("digest"))


@query("""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id IN (0, 1, 2)), s AS (SELECT e.vec_id, max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) AS score
          FROM embeddings e, q WHERE CAST(e.label AS VARCHAR) LIKE '1%' OR e.label % 2 = 0 GROUP BY e.vec_id) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 6""")
def multi_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three searches over nodes of an id prefix, the best score of each node, the best six nodes: cut first, then merged."""
    at = views.table(spark, sf_dir, "embeddings").where(F.col("label").cast("string").startswith("1") | (F.col("label") % 2 == 0))
    tops = [vector.top_k(vector.scored(at, query_vector(spark, sf_dir, q)), 6, id_col="vec_id").select("vec_id", "score") for q in (0, 1, 2)]
    best = tops[0].unionByName(tops[1]).unionByName(tops[2]).groupBy("vec_id").agg(F.max("score").alias("score"))
    return rounded(vector.top_k(best, 6, id_col="vec_id"), "score")


@query("""SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, count(*) AS n_siblings, sum(b.l_quantity) AS quantity
          FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND NOT (a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey) WHERE a.l_quantity = 50 GROUP BY ALL""")
def siblings_same_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = views.table(spark, sf_dir, "lineitem")
    keys = ["l_linenumber", "l_partkey", "l_suppkey"]
    seed = li.where("l_quantity = 50").select("l_orderkey", *keys)
    other = li.select("l_orderkey", *(F.col(k).alias(f"o_{k}") for k in keys), F.col("l_quantity").alias("q"))
    same = [F.col(k) == F.col(f"o_{k}") for k in keys]
    at = seed.join(other, "l_orderkey").where(~(same[0] & same[1] & same[2]))
    return at.groupBy("l_orderkey", *keys).agg(F.count("*").alias("n_siblings"), F.sum("q").alias("quantity"))


@query(f"""WITH {SCORES}, r AS (SELECT l_orderkey, max(score) AS score, count(*) AS n_rows, count(score) AS n_scored FROM lineitem LEFT JOIN scores ON l_partkey = vec_id GROUP BY 1)
           SELECT o_orderkey, round(score, 6) AS score, coalesce(n_rows, 0) AS n_rows, coalesce(n_scored, 0) AS n_scored FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""")
def tables_with_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir).select(F.col("vec_id").alias("l_partkey"), "score")
    rows = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(s, "l_partkey", "left")
    per = rows.groupBy("l_orderkey").agg(F.max("score").alias("score"), F.count("*").alias("n_rows"), F.count("score").alias("n_scored"))
    at = views.table(spark, sf_dir, "orders").select("o_orderkey").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rounded(at.select("o_orderkey", "score", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_scored", F.lit(0)).alias("n_scored")), "score")


CASES = f"""{PER_LABEL}, runs AS (SELECT label, list(CAST(vec_id AS VARCHAR) ORDER BY rank) AS ids FROM ranked WHERE rank <= 12 GROUP BY label),
    cases AS (SELECT label AS id, 'g' || label % 3 AS grp, ids[1:6] AS selected, ids[7:12] AS expanded, CASE WHEN label % 4 = 0 THEN [[ids[2]], [ids[8]]] WHEN label % 4 = 1 THEN [[ids[9], 'x']] WHEN label % 4 = 2 THEN [[ids[1], ids[12]]] ELSE [['none']] END AS gold,
              CASE WHEN label % 5 < 4 THEN CAST(label % 2 AS INT) END AS accurate FROM runs),
    hits AS (SELECT *, CAST(len(list_filter(gold, lambda g: NOT list_has_any(selected, g))) = 0 AS INT) AS direct_hit,
              CAST(len(list_filter(gold, lambda g: NOT list_has_any(list_concat(selected, expanded), g))) = 0 AS INT) AS final_hit FROM cases),
    graded AS (SELECT *, CAST(direct_hit = 0 AND final_hit = 1 AS INT) AS recovered FROM hits)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation case for each label: its best six selected, the next six by expansion, gold of several forms."""
    top = vector.top_k(scores(spark, sf_dir), 12, ["label"], id_col="vec_id")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").cast("string").alias("v")))), lambda x: x["v"])
    at = top.groupBy("label").agg(ids.alias("ids"))
    one = lambda i: F.get("ids", F.lit(i - 1))
    kind = F.col("label") % 4
    gold = F.when(kind == 0, F.array(F.array(one(2)), F.array(one(8)))).when(kind == 1, F.array(F.array(one(9), F.lit("x")))).when(kind == 2, F.array(F.array(one(1), one(12)))).otherwise(F.array(F.array(F.lit("none"))))
    return at.select(F.col("label").alias("id"), F.concat(F.lit("g"), F.col("label") % 3).alias("group"), F.slice("ids", 1, 6).alias("selected"), F.slice("ids", 7, 6).alias("expanded"), gold.alias("groups"), F.when(F.col("label") % 5 < 4, (F.col("label") % 2).cast("int")).alias("accurate"))


@query(f"""WITH {CASES} SELECT id, direct_hit, final_hit, recovered, CASE WHEN accurate IS NULL THEN 'UNGRADED' WHEN final_hit = 1 AND accurate = 1 THEN 'OK' WHEN accurate = 1 THEN 'GOLD_AUDIT'
           WHEN final_hit = 0 THEN 'EVIDENCE_MISS' ELSE 'GENERATION' END AS error_class FROM graded""")
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scored(cases(spark, sf_dir), 6).select("id", "direct_hit", "final_hit", "recovered", "error_class")


@query(f"""WITH {CASES} SELECT CASE WHEN grouping(grp) = 1 THEN 'Overall' ELSE grp END AS "group", count(*) AS n, round(100.0 * sum(direct_hit) / count(*), 1) AS direct_rate, round(100.0 * sum(final_hit) / count(*), 1) AS final_rate,
           count(*) FILTER (direct_hit = 0) AS missed, CAST(sum(recovered) AS BIGINT) AS recovered, round(100.0 * sum(recovered) / nullif(count(*) FILTER (direct_hit = 0), 0), 1) AS recovery_rate,
           round(100.0 * sum(accurate) / nullif(count(accurate), 0), 1) AS accuracy FROM graded GROUP BY GROUPING SETS ((grp), ())""")
def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(evaluate.scored(cases(spark, sf_dir), 6))


@query(f"""WITH {H}, n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM headed_rows),
           c AS (SELECT *, CASE WHEN l_orderkey % 4 IN (0, 3) THEN '' END AS x FROM n),
           f AS (SELECT l_orderkey, i, headers[1] AS h1, CASE WHEN i % 3 = 1 OR headers[1] = 'STT' THEN CASE WHEN i % 3 = 1 THEN cells[1] ELSE '' END
                   ELSE last_value(CASE WHEN i % 3 = 1 THEN cells[1] END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY i) END AS first_cell,
                   coalesce(last_value(cells[2] IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY i), '') AS second_cell FROM c)
           SELECT l_orderkey, CAST(i AS INT) AS i, first_cell, second_cell FROM f""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three rows lose their first cell and take it from above again, but not in a column of row numbers."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    at = views.headed_rows(spark, sf_dir).withColumn("i", F.row_number().over(w)).select("l_orderkey", "i", "headers", "cells")
    at = at.withColumn("cells", F.when(F.col("i") % 3 == 1, F.col("cells")).otherwise(F.concat(F.array(F.lit("")), F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))))))
    out = tables.forward_filled(at, ["l_orderkey"], ["i"])
    return out.select("l_orderkey", "i", F.get("cells", F.lit(0)).alias("first_cell"), F.get("cells", F.lit(1)).alias("second_cell"))
