"""Catalogue: documents built from blocks of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import building
from lodestack.plans.registry import query
from lodestack.plans.texts import HEADS, _headed

PER_BLOCK = 6

BLOCKS = f"""{HEADS},
    r AS (SELECT doc_id, pos, pos // 6 AS b, CASE WHEN pos % 7 = 3 THEN '- ' || line WHEN pos % 11 = 4 THEN line || '-' WHEN pos % 13 = 6 THEN '' WHEN pos % 5 = 2 THEN lower(line[1]) || line[2:] ELSE line END AS raw FROM headed),
    blocks AS (SELECT doc_id, b, string_agg(raw, chr(10) ORDER BY pos) AS text, CASE b % 5 WHEN 0 THEN 'tieu_de' WHEN 1 THEN 'ghi_chu' ELSE 'doan_van' END AS kind, b * 100.0 AS y0, b * 100.0 + 12 * count(*) AS y1 FROM r GROUP BY doc_id, b)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six lines of a document as a block: numbered ones, bullets, lines with a hyphen at the end, blank ones, and such as begin in small letters."""
    at, line, pos = _headed(spark, sf_dir), F.col("line"), F.col("pos")
    raw = F.when(pos % 7 == 3, F.concat(F.lit("- "), line)).when(pos % 11 == 4, F.concat(line, F.lit("-"))).when(pos % 13 == 6, "").when(pos % 5 == 2, F.concat(F.lower(F.substring(line, 1, 1)), F.substring(line, 2, 1 << 30))).otherwise(line)
    at = at.select("doc_id", F.floor(pos / PER_BLOCK).cast("long").alias("b"), "pos", raw.alias("raw"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n")
    at = at.groupBy("doc_id", "b").agg(text.alias("text"), F.count("*").alias("n"))
    kind = F.when(F.col("b") % 5 == 0, "tieu_de").when(F.col("b") % 5 == 1, "ghi_chu").otherwise("doan_van")
    y0 = (F.col("b") * 100).cast("double")
    return at.select("doc_id", "b", "text", kind.alias("kind"), y0.alias("y0"), (y0 + 12 * F.col("n")).alias("y1"))


_STRUCTURE = r"'(?i)^ *(CHƯƠNG +([IVXLCDM]+|\d+)([^\wÀ-ỹ]|$)|ĐIỀU +\d+([^\wÀ-ỹ]|$)|PHỤ +LỤC([^\wÀ-ỹ]|$)|MỤC +([IVXLCDM]+|\d+)([^\wÀ-ỹ]|$)|BƯỚC +\d+([^\wÀ-ỹ]|$)|[IVXLCDM]+ *[.)] +\S|\d+(\.\d+)+ *[.)]? +\S|\d+ *[.)] +\S)'"
_BULLET = r"'(?i)^ *([-+•▪◦‣–—]|\( *[a-zđ] *\)|[a-zđ] *[).]) +'"
_TERMINAL = r"""'[.:;?!…]["”’'')\]]*$'"""
_UPPER = r"'^[^\pL\d]*\p{Lu}'"


def _join(left: str, right: str) -> str:
    """One fold step of joining wrapped pieces, in SQL."""
    return rf"""CASE WHEN {left} = '' THEN {right} WHEN regexp_matches({left}, '[^ ]-$') AND NOT (regexp_matches({left}, '\d-$') AND regexp_matches({right}, '^\d')) AND regexp_matches({right}, '^[^\pL\d]*\p{{Ll}}') AND NOT regexp_matches({right}, {_BULLET})
        THEN left({left}, length({left}) - 1) || {right} WHEN right({left}, 1) = '-' AND NOT regexp_matches({right}, {_BULLET}) THEN {left} || {right} ELSE {left} || ' ' || {right} END"""


SEGMENTS = rf"""{BLOCKS},
    l0 AS (SELECT doc_id, b, kind AS base, y0, y1, string_split(text, chr(10)) AS ls, len(ls) AS n FROM blocks),
    l1 AS (SELECT doc_id, b, base, y0, y1, n, i - 1 AS i, trim(regexp_replace(ls[i], '\s+', ' ', 'g')) AS line FROM l0, unnest(range(1, n + 1)) AS u(i)),
    l2 AS (SELECT *, lag(line) OVER (PARTITION BY doc_id, b ORDER BY i) AS bef FROM l1),
    l3 AS (SELECT *, sum(CASE WHEN coalesce(bef, '') = '' OR regexp_matches(line, {_STRUCTURE}) OR regexp_matches(line, {_BULLET}) OR regexp_matches(bef, {_TERMINAL}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, b ORDER BY i) AS run FROM l2 WHERE line <> ''),
    l4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, b, run ORDER BY i) > 1 AS aft, regexp_matches(first_value(line) OVER (PARTITION BY doc_id, b, run ORDER BY i), '^\d+(\.\d+)*[.)] +\S') AS num FROM l3),
    l5 AS (SELECT *, sum(CASE WHEN aft AND regexp_matches(line, {_UPPER}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, b, run ORDER BY i) AS caps FROM l4),
    l6 AS (SELECT *, sum(CASE WHEN NOT aft OR (num AND caps = 1 AND regexp_matches(line, {_UPPER})) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, b ORDER BY i) AS whole FROM l5),
    m1 AS (SELECT doc_id, b, base, y0, y1, n, whole, list_reduce(list(line ORDER BY i), lambda x, y: {_join("x", "y")}) AS line, min(i) AS fi, max(i) AS la FROM l6 GROUP BY ALL),
    m2 AS (SELECT *, CASE WHEN regexp_matches(line, {_STRUCTURE}) THEN 'heading' WHEN count(*) OVER (PARTITION BY doc_id, b) = 1 THEN base WHEN regexp_matches(line, {_BULLET}) THEN 'bullet' END AS k FROM m1),
    m3 AS (SELECT *, lag(k, 1, 'heading') OVER w AS lk, last_value(k = 'heading' IGNORE NULLS) OVER w AS hd FROM m2 WINDOW w AS (PARTITION BY doc_id, b ORDER BY fi)),
    m4 AS (SELECT *, sum(CASE WHEN k IS NOT NULL OR lk IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, b ORDER BY fi) AS seg FROM m3),
    seg AS (SELECT doc_id, b, seg, coalesce(max(k), base) AS kind, CASE WHEN bool_or(k IS NULL AND coalesce(hd, false)) THEN string_agg(line, ' ' ORDER BY fi) ELSE list_reduce(list(line ORDER BY fi), lambda x, y: {_join("x", "y")}) END AS text,
                   y0 + (y1 - y0) * min(fi) / n AS y0, y0 + (y1 - y0) * (max(la) + 1) / n AS y1 FROM m4 GROUP BY doc_id, b, base, m4.y0, m4.y1, n, seg)"""


@query(f"WITH {SEGMENTS} SELECT doc_id, b, CAST(seg AS BIGINT) AS seg, kind, md5(text) AS digest, round(y0, 6) AS y0, round(y1, 6) AS y1 FROM seg")
def block_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of six lines as headings, bullets and what lies between them, with their shares of the block."""
    at = building.segments(_blocks(spark, sf_dir), ["doc_id"], "b")
    return at.select("doc_id", "b", F.col("seg").cast("long").alias("seg"), "kind", F.md5("text").alias("digest"), F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"))


@query(rf"""WITH {SEGMENTS}, pc AS (SELECT doc_id, b * 1000 + seg AS pos, kind, text FROM seg),
            lg AS (SELECT *, lag(kind) OVER w AS lk, lag(text) OVER w AS lt FROM pc WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
            gr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, sum(CASE WHEN lk IS NULL OR lk IN ('heading', 'tieu_de') OR kind IN ('heading', 'tieu_de') OR regexp_matches(text, {_STRUCTURE}) OR regexp_matches(text, {_BULLET}) OR regexp_matches(lt, {_TERMINAL}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM lg)
            SELECT doc_id, min(n) AS first, arg_min(kind, n) AS kind, md5(list_reduce(list(text ORDER BY n), lambda x, y: {_join("x", "y")})) AS digest, count(*) AS n FROM gr GROUP BY doc_id, g""")
def document_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all blocks of a document in order, those that go on joined to the one before."""
    at = building.segments(_blocks(spark, sf_dir), ["doc_id"], "b").withColumn("pos", F.col("b") * 1000 + F.col("seg")).withColumn("item", F.lit("text"))
    return building.content(at, ["doc_id"], ["pos"]).select("doc_id", F.col("first").cast("long").alias("first"), "kind", F.md5("text").alias("digest"), "n")


SAID = ("Quy định chung", "- Danh mục lớp", "Kết quả như sau:", "Phòng nào cũng có", "PHỤ LỤC 1", "Lịch thi học kỳ", "", "Về lịch thi học kỳ 1")
PAGE_ITEMS = """it AS (SELECT o_custkey AS doc, o_orderkey AS pos, o_orderkey // 40 % 3 + 1 AS page, CASE WHEN o_orderkey % 9 = 0 THEN 'table' ELSE 'text' END AS item, CAST((o_orderkey * 7 + o_custkey) % 8 AS INT) AS k,
           CASE (o_orderkey + o_custkey * 3) % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'bullet' WHEN 2 THEN 'doan_van' WHEN 3 THEN 'tieu_de' ELSE 'metadata' END AS kind,
           CASE WHEN o_orderkey % 18 = 0 THEN '' WHEN o_orderkey % 27 = 0 THEN 'Lịch thi' WHEN o_orderkey % 9 = 0 THEN 'Bảng điểm' END AS title, 'Lịch thi học kỳ 1' AS doc_title,
           ['Quy định chung', '- Danh mục lớp', 'Kết quả như sau:', 'Phòng nào cũng có', 'PHỤ LỤC 1', 'Lịch thi học kỳ', '', 'Về lịch thi học kỳ 1'][k + 1] AS text FROM orders)"""


def _page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of their customer's document, every ninth a table, in one of eight texts and five kinds."""
    from lodestack.plans.views import table

    k = F.col("o_orderkey")
    kinds = F.element_at(F.array(*map(F.lit, ("heading", "bullet", "doan_van", "tieu_de", "metadata"))), ((k + F.col("o_custkey") * 3) % 5 + 1).cast("int"))
    said = F.element_at(F.array(*map(F.lit, SAID)), ((k * 7 + F.col("o_custkey")) % 8 + 1).cast("int"))
    title = F.when(k % 18 == 0, "").when(k % 27 == 0, "Lịch thi").when(k % 9 == 0, "Bảng điểm")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("pos"), (F.floor(k / 40) % 3 + 1).alias("page"), F.when(k % 9 == 0, "table").otherwise("text").alias("item"), kinds.alias("kind"), title.alias("title"), said.alias("text"))


@query(f"""WITH {PAGE_ITEMS}, m AS (SELECT *, CASE WHEN item = 'table' THEN '' WHEN text = '' OR contains('lịch thi học kỳ 1', lower(text)) OR contains(lower(text), 'lịch thi học kỳ 1') THEN NULL
              WHEN kind = 'bullet' THEN ltrim(text, '- ') WHEN kind = 'heading' THEN text WHEN kind = 'tieu_de' THEN CASE WHEN starts_with(text, 'PHỤ LỤC') THEN text END WHEN kind = 'doan_van' AND text LIKE '%như sau:' THEN NULL ELSE '' END AS mark FROM it),
           i AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS inferred FROM m)
           SELECT doc, pos, title, inferred, CASE WHEN inferred <> '' AND title IN ('', 'Lịch thi') THEN inferred WHEN title = 'Lịch thi' THEN '' ELSE title END AS found FROM i WHERE item = 'table'""")
def table_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles that tables get from what precedes them."""
    return building.table_titles(_page_items(spark, sf_dir).withColumn("doc_title", F.lit("Lịch thi học kỳ 1")), "doc")


@query(f"""WITH {PAGE_ITEMS}, c AS (SELECT * FROM it WHERE item = 'table' OR (kind <> 'metadata' AND text <> '' AND NOT (kind = 'tieu_de' AND page = 1 AND NOT starts_with(text, 'PHỤ LỤC') AND (contains('lịch thi học kỳ 1', lower(text)) OR contains(lower(text), 'lịch thi học kỳ 1')))))
           SELECT doc, page, pos, item, kind, row_number() OVER (PARTITION BY doc, page ORDER BY pos) = 1 AS starts_page FROM c""")
def page_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are content, without metadata and the document's title; the first of each page is marked."""
    items = _page_items(spark, sf_dir)
    titles = items.select("doc").distinct().withColumn("doc_title", F.lit("Lịch thi học kỳ 1"))
    return building.meaningful(items, "doc", titles).select("doc", "page", "pos", "item", "kind", "starts_page")
