"""Curricula: course tables with blocks, requirements and groups; sections under headers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import render, text
from lodestack.sources.shared import dealt_join

CODE = r"[A-Z]{2,3}\d{3}[A-Z]*"
BLOCK = "BLOCK_HEADER:"
# What the columns of a course table are, by place.
COLUMNS = ("marker", "code", "name", "credits", "required", "elective", "theory", "practice", "before", "beside")
# Names that relations have in stored curricula, and those that questions use.
RENAMED = {
    "CO_KHOI_KIEN_THUC": "GOM", "GOM_HOC_PHAN": "GOM", "CO_NHOM_THANH_PHAN": "DOI_VOI", "DUOC_BAN_HANH_THEO": "BAN_HANH_THEO", "DAO_TAO_TRINH_DO": "DAO_TAO", "CO_LOAI_VAN_BANG": "CAP",
    "DAO_TAO_THEO_HINH_THUC": "CO", "DAO_TAO_THEO_PHUONG_THUC": "CO", "CO_MUC_TIEU_DAO_TAO": "CO", "CO_CO_HOI_VIEC_LAM": "CO", "DAT_CHUAN_DAU_RA": "CO", "THAM_CHIEU": "THAM_KHAO", "TAO_NEN_TANG": "DAT_DUOC",
}


def course_rows(rows: DataFrame, by: str = "program", order: str = "pos", cells_col: str = "cells") -> DataFrame:
    """Rows of course tables with the block, requirement and group they stand under.

    A block's header resets both others, as do its summary row and a row with required credits. A
    requirement holds until reset; a group is one only under a requirement. Short rows are null beyond their end.
    """
    cell = [F.trim(F.coalesce(F.get(F.col(cells_col), F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(COLUMNS)]
    at = rows.select(by, order, *cell, F.array_join(cells_col, " ").alias("row_text"))
    w = Window.partitionBy(by).orderBy(order)
    header, summary, digits = F.col("marker").contains(BLOCK), F.col("marker").startswith("Cộng"), F.col("required").rlike(r"^\d+$")
    at = at.withColumn("block", F.last(F.when(header, F.trim(F.replace("marker", F.lit(BLOCK), F.lit("")))), ignorenulls=True).over(w))
    at = at.withColumn("kind", F.when(header, "block").when(summary, "summary").otherwise("row")).withColumn("s", F.sum((header | summary | digits).cast("int")).over(w))
    island = Window.partitionBy(by, "s").orderBy(order)
    plain = F.col("kind") == "row"
    at = at.withColumn("requirement", F.last(F.when(plain & (F.col("elective") != ""), F.col("elective")), ignorenulls=True).over(island))
    group = F.when(plain & (F.col("required") != "") & ~digits & F.col("requirement").isNotNull(), F.col("required"))
    return at.withColumn("group", F.last(group, ignorenulls=True).over(island)).drop("s")


def courses(rows: DataFrame, by: str = "program") -> DataFrame:
    """Courses of ``course_rows()``: one row a code, with what it belongs to and whether it is required."""
    at = rows.where("kind = 'row'").withColumn("code", F.explode(F.regexp_extract_all(F.replace("code", F.lit(" "), F.lit("")), F.lit(CODE), F.lit(0))))
    parent = F.when(F.col("group").isNotNull(), F.concat_ws("/", "block", "requirement", "group")).when(F.col("requirement").isNotNull(), F.concat_ws("/", "block", "requirement")).otherwise(F.col("block"))
    return at.select(by, "code", F.trim(F.replace("name", F.lit("(*)"), F.lit(""))).alias("name"), F.col("credits").try_cast("int").alias("credits"), parent.alias("parent"), F.col("requirement").isNull().alias("required"), "before", "beside")


def course_relations(found: DataFrame, by: str = "program") -> DataFrame:
    """Edges of courses: what contains them, what comes before and what may run beside them."""
    contains = found.where("parent is not null").select(by, F.col("parent").alias("src"), F.col("code").alias("dst"), F.lit("GOM").alias("type"))
    out = contains
    for column, kind in (("before", "YEU_CAU_TIEN_QUYET"), ("beside", "CO_THE_SONG_HANH")):
        out = out.unionByName(found.select(by, F.col("code").alias("src"), F.explode(F.regexp_extract_all(column, F.lit(CODE), F.lit(0))).alias("dst"), F.lit(kind).alias("type")))
    return out.distinct()


def block_credits(rows: DataFrame, by: str = "program") -> DataFrame:
    """(by, block, total, required, elective) credits from the blocks' summary rows, 0 where a row names none; the last row counts."""
    number = lambda word: F.coalesce(F.regexp_extract("row_text", rf"(?iU){word}.*?(\d+)\s*TC", 1).try_cast("int"), F.lit(0))
    at = rows.where("kind = 'summary' and block is not null").withColumn("c", F.struct(number("Cộng").alias("total"), number("Bắt buộc").alias("required"), number("Tự chọn").alias("elective")))
    return at.groupBy(by, "block").agg(F.max_by("c", "pos").alias("c")).select(by, "block", "c.*")


def sections(nodes: DataFrame, by: str = "doc_id", order: str = "pos", text_col: str = "text") -> DataFrame:
    """Texts under their last major header (## and a number), joined by blank lines; texts before the first stay alone."""
    w = Window.partitionBy(by).orderBy(order)
    at = nodes.withColumn("n", F.sum(F.trim(F.col(text_col)).rlike(r"^##\s+\d+").cast("int")).over(w))
    key = F.when(F.col("n") == 0, -F.col(order) - 1).otherwise(F.col("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t")))), lambda x: x["t"]), "\n\n")
    return at.groupBy(by, key.alias("key")).agg(F.min(order).alias(order), text.alias(text_col)).select(by, order, text_col)


def renamed(edges: DataFrame) -> DataFrame:
    """Edges with the relation names that questions use; names without a counterpart stay."""
    names = F.create_map(*(F.lit(x) for kv in RENAMED.items() for x in kv))
    return edges.withColumn("type", F.coalesce(names[F.col("type")], F.col("type")))


def sufficient(nodes: DataFrame, edges: DataFrame, text_chars: int) -> bool:
    """Whether a graph's answer needs no search by vectors: an edge and two nodes, or a node and 180 characters of text."""
    n, e = nodes.limit(2).count(), edges.limit(1).count()
    return (e >= 1 and n >= 2) or (n >= 1 and text_chars >= 180)


# What sections of curricula are about, by words of their headers.
CONCEPTS = {
    "MUC_TIEU": ("mục tiêu", "objectives", "goal"),
    "CHUAN_DAU_RA": ("chuẩn đầu ra", "learning outcomes", "plo", "cdr", "chuẩn đr", "kiến thức kỹ năng thái độ"),
    "VI_TRI_VIEC_LAM": ("vị trí việc làm", "cơ hội nghề nghiệp", "nghề nghiệp", "việc làm", "công việc", "vị trí làm việc"),
    "KHA_NANG_HOC_TAP": ("khả năng học tập", "nâng cao trình độ", "học tập suốt đời", "sau đại học"),
    "KHUNG_CHUONG_TRINH": ("khung chương trình", "danh sách học phần", "kế hoạch đào tạo"),
    "THAM_KHAO": ("tài liệu tham khảo", "tham khảo", "tham chiếu", "căn cứ pháp lý"),
    "THONG_TIN_CHUNG": ("thông tin chung", "tổng quan"),
}
RELATION_HINTS = ("BAN_HANH_THEO", "DAO_TAO", "THUOC_VE", "CAP", "CO", "THAM_KHAO", "DAT_DUOC", "YEU_CAU", "GOM", "DOI_VOI", "YEU_CAU_TIEN_QUYET", "CO_THE_SONG_HANH")
ANCHOR_TYPES = ("ChuongTrinhDaoTao", "Nganh", "KhoiKienThuc", "HocPhan", "ChuanDauRa", "DieuKienTotNghiep", "VanBanPhapLy", "Khoa", "BoMon")
QUERY_TYPES = ("attribute", "relation", "path", "aggregation", "description", "list")
VECTOR_TARGETS = ("HocPhan", "DieuKienTotNghiep", "ChuanDauRa", "VanBanPhapLy")
ANSWER_SHAPES = ("single", "list", "path", "summary")
DEFAULT_COHORT, DEFAULT_MODE = 51, "đại trà"


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)).replace("đ", "d")


def concept(header: Column) -> Column:
    """What a section is about, the first of the list whose words its header holds, accents or not; else UNKNOWN."""
    h = text.folded(header)
    return F.coalesce(*(F.when(text.contains_any(h, [_plain(w) for w in words]), F.lit(key)) for key, words in CONCEPTS.items()), F.lit("UNKNOWN"))


def outcomes(lines: DataFrame, by: str = "program", order: str = "pos", text_col: str = "line") -> DataFrame:
    """(by, order, code, content, category, subcategory): the listed items of learning outcomes.

    Headers number two or three parts; the category is the last header of two, the subcategory the last of three
    since then, Chung (general) without one. Codes in brackets count and leave the text; items without one are
    numbered CDR_01 and on in order. Blank and other lines give nothing.
    """
    t, code = F.col("t"), r"(?i)\(((?:PLO|CDR|PO)\d+)\)"
    item = r"(?dU)^(?:[a-z]\.|-|\+|\*)\s+(.*)$"
    title = lambda pattern: F.regexp_replace(F.regexp_extract(t, pattern, 1), r"^[#* ]+|[#* ]+$", "")
    second, first = r"(?dU)^(?:####\s+)?\d+\.\d+\.\d+\.?\s+(.*)$", r"(?dU)^(?:###\s+)?\d+\.\d+\s+(.*)$"
    at = lines.select(by, order, F.regexp_replace(F.coalesce(text_col, F.lit("")), r"(?U)^\s+|\s+$", "").alias("t")).where("t <> ''")
    w = Window.partitionBy(by).orderBy(order)
    at = at.withColumn("kind", F.when(t.rlike(second), 2).when(t.rlike(first), 1).when(t.rlike(item), 0)).where("kind is not null")
    at = at.withColumn("category", F.last(F.when(F.col("kind") == 1, title(first)), ignorenulls=True).over(w)).withColumn("s", F.count_if(F.col("kind") == 1).over(w))
    at = at.withColumn("subcategory", F.last(F.when(F.col("kind") == 2, title(second)), ignorenulls=True).over(Window.partitionBy(by, "s").orderBy(order)))
    at = at.where("kind = 0").withColumn("content", F.trim(F.regexp_extract(t, item, 1))).withColumn("named", F.nullif(F.upper(F.regexp_extract("content", code, 1)), F.lit("")))
    n = F.count_if(F.col("named").isNull()).over(w).cast("string")
    own = F.concat(F.lit("CDR_"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n))
    clean = F.when(F.col("named").isNull(), F.col("content")).otherwise(F.regexp_replace(F.replace("content", F.regexp_extract("content", code, 0), F.lit("")), r"^[ ;.,]+|[ ;.,]+$", ""))
    return at.select(by, order, F.coalesce("named", own).alias("code"), clean.alias("content"), F.coalesce("category", F.lit("Chung")).alias("category"), F.coalesce("subcategory", F.lit("Chung")).alias("subcategory"))


def program_fields(major: Column, content: Column, full_text: Column) -> Column:
    """A program's fields from its text, as a struct: cohort by the first year (0 without one), kind, id, language, credits
    and years as text (0 if missing), degree, form and method (Unknown if missing)."""
    whole, body = F.coalesce(full_text, F.lit("")), F.coalesce(content, F.lit(""))
    found = lambda pattern, default, group=1: F.coalesce(F.nullif(F.trim(F.regexp_extract(body, r"(?idU)" + pattern, group)), F.lit("")), F.lit(default))
    cohort = F.coalesce(text.cohort_of_year(F.regexp_extract(whole, r"(?idU)năm\s+(\d{4})", 1).try_cast("int")), F.lit(0))
    high = F.contains(F.lower(whole), F.lit("chất lượng cao"))
    return F.struct(
        F.concat_ws("_", major, cohort.cast("string"), F.when(high, "CLC").otherwise("STD")).alias("program"), cohort.alias("cohort"),
        F.when(high, "Chất lượng cao").otherwise("Đại trà").alias("kind"), F.when(high, "Tiếng Anh").otherwise("Tiếng Việt").alias("language"),
        found(r"(?:Số lượng tín chỉ|Tổng cộng)[:-]\s*(\d+)", "0").alias("credits"), F.replace(found(r"Thời gian đào tạo:\s*([\d.,]+)", "0"), F.lit(","), F.lit(".")).alias("years"),
        found(r"(?:Loại văn bằng|Danh hiệu):\s*(.+)", "Unknown").alias("degree"), found(r"Hình thức đào tạo:\s*(.+)", "Unknown").alias("form"), found(r"Phương thức tổ chức đào tạo:\s*(.+)", "Unknown").alias("method"),
    )


def _known(values: Column, allowed: tuple, change=F.trim) -> Column:
    tidy = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: change(F.coalesce(x, F.lit(""))))
    return F.filter(tidy, lambda x: x.isin(*allowed))


def plan(anchors: Column, entity_types: Column, relations: Column, asked: Column, depth: Column, paths: Column, nodes: Column, shape: Column, defaults: tuple[int, int, int] = (2, 120, 120)) -> Column:
    """A plan for the search of a graph, as a struct, made safe: known anchors (else those of the question's entities), at
    most three; known relations (else those asked for), each once, at most four; bounds in their ranges, the default
    where they are no numbers; a known shape of the answer, else summary."""
    first, rest = _known(anchors, ANCHOR_TYPES), F.array_distinct(_known(entity_types, ANCHOR_TYPES))
    upper = lambda x: F.upper(F.trim(x))
    given, wanted = (F.array_distinct(_known(c, RELATION_HINTS, upper)) for c in (relations, asked))
    bound = lambda c, default, low, high: F.greatest(F.lit(low), F.least(F.coalesce(c.try_cast("int"), F.lit(default)), F.lit(high)))
    s = F.lower(F.trim(F.coalesce(shape, F.lit("summary"))))
    return F.struct(
        F.slice(F.when(F.size(first) > 0, first).otherwise(rest), 1, 3).alias("anchors"), F.slice(F.when(F.size(given) > 0, given).otherwise(wanted), 1, 4).alias("relations"),
        bound(depth, defaults[0], 1, 2).alias("max_depth"), bound(paths, defaults[1], 10, 120).alias("max_paths"), bound(nodes, defaults[2], 20, 120).alias("max_nodes"),
        F.when(s.isin(*ANSWER_SHAPES), s).otherwise("summary").alias("shape"),
    )


ANALYSIS = (
    "rewrite string, rewritten_query string, query_type string, entities array<struct<type:string, value:string>>, relations array<string>, constraints struct<depth:string>, vector_targets array<string>, "
    "ctdt_filters struct<khoa:string, he:string>, graph_plan struct<anchor_node_types:array<string>, focus_relations:array<string>, expansion_policy:struct<max_depth:string, max_paths:string, max_nodes:string>, answer_shape:string>"
)


def analysis(answer: Column, question: Column, targets: tuple[str, ...] = VECTOR_TARGETS) -> Column:
    """What a model's answer says about a question, as a struct, made safe; an answer that holds no object, or nothing in a place, leaves
    the defaults there: the question itself, no entities, relations, targets or filters, a description, the widest search.

    Entities have a type or a value; relations are upper case and not blank; targets are known, at most two; the
    cohort is the first number given; the plan is that of ``plan``, whose shape follows from the type of the query
    where none is known, and whose depth from the constraints.
    """
    tidy = lambda c: F.trim(F.coalesce(c, F.lit("")))
    none = F.array().cast("array<string>")

    def of(a: Column) -> Column:
        entities = F.filter(
            F.transform(F.coalesce(a["entities"], F.array().cast("array<struct<type:string, value:string>>")), lambda e: F.struct(tidy(e["type"]).alias("type"), tidy(e["value"]).alias("value"))),
            lambda e: (e["type"] != "") | (e["value"] != ""),
        )
        relations = F.filter(F.transform(F.coalesce(a["relations"], none), lambda r: F.upper(tidy(r))), lambda r: r != "")
        kind, p, grow = query_type(a["query_type"]), a["graph_plan"], a["graph_plan"]["expansion_policy"]
        shape, by_kind = F.lower(tidy(p["answer_shape"])), F.when(kind == "path", "path").when(kind.isin("list", "relation"), "list").when(kind.isin("attribute", "aggregation"), "single").otherwise("summary")
        made = plan(
            p["anchor_node_types"], F.transform(entities, lambda e: e["type"]), p["focus_relations"], relations, F.coalesce(grow["max_depth"], a["constraints"]["depth"]), grow["max_paths"], grow["max_nodes"],
            F.when(shape.isin(*ANSWER_SHAPES), shape).otherwise(by_kind), (2, 60, 70),
        )
        return F.struct(
            F.coalesce(F.nullif(tidy(a["rewrite"]), F.lit("")), F.nullif(tidy(a["rewritten_query"]), F.lit("")), question).alias("rewrite"), entities.alias("entities"), relations.alias("relations"), kind.alias("query_type"),
            F.regexp_extract(tidy(a["ctdt_filters"]["khoa"]), r"\d+", 0).try_cast("int").alias("cohort"), F.nullif(tidy(a["ctdt_filters"]["he"]), F.lit("")).alias("mode"),
            F.slice(_known(a["vector_targets"], targets), 1, 2).alias("vector_targets"), made.alias("plan"),
        )

    return text.let(render.salvaged_json(answer, ANALYSIS), of)


def query_type(value: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin(*QUERY_TYPES), v).otherwise("description")


def program_filter(cohort: Column, mode: Column) -> Column:
    """The program that a question is about, as a struct: the first number of the cohort and the mode, the defaults where they are missing, and whether one was used."""
    c, m = F.regexp_extract(F.coalesce(cohort, F.lit("")), r"\d+", 0).try_cast("int"), F.nullif(F.trim(mode), F.lit(""))
    return F.struct(F.coalesce(c, F.lit(DEFAULT_COHORT)).alias("cohort"), F.coalesce(m, F.lit(DEFAULT_MODE)).alias("mode"), (c.isNull() | m.isNull()).alias("used_default"))


def of_programs(asked: DataFrame, programs: DataFrame) -> DataFrame:
    """Questions (query_id, cohort, mode) with the programs (id, cohort, mode) of that cohort, as text, and mode, without case and blanks at the ends."""
    keys = (F.col("cohort").cast("string").alias("_c"), F.lower(F.trim(F.coalesce("mode", F.lit("")))).alias("_m"))
    return dealt_join(asked.select("query_id", *keys), programs.select("id", *keys), ["_c", "_m"]).select("query_id", "id")


def hybrid(graphs: DataFrame, candidates: DataFrame, edges: DataFrame, relations: tuple[str, ...], per_target: int = 3, per_origin: int = 4, most: int = 12) -> DataFrame:
    """Answers by vectors where the graph's answer is too thin: (query_id, origin, id, target, score, type).

    graphs (query_id, n_nodes, n_edges, n_chars) with an edge and two nodes, or a node and 180 characters, need none.
    For the others the best candidates (query_id, target, id, score) of each target, origin null; and one step from
    these by edges (src, dst, type) of the relations, each once, capped for each origin and in all. The step's rows
    have a type and neither target nor score. Questions come in batches; nothing decides on the driver.
    """
    thin = graphs.where(~(((F.col("n_edges") >= 1) & (F.col("n_nodes") >= 2)) | ((F.col("n_nodes") >= 1) & (F.col("n_chars") >= 180)))).select("query_id")
    best = Window.partitionBy("query_id", "target").orderBy(F.desc("score"), "id")
    direct = candidates.join(thin, "query_id", "left_semi").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= per_target).drop("_r")
    # a step's edges are cut at their origin, before they meet the questions
    step = edges.where(F.col("type").isin(*relations)).select("src", "dst", "type").distinct()
    step = step.withColumn("i", F.row_number().over(Window.partitionBy("src").orderBy("type", "dst"))).where(F.col("i") <= per_origin)
    out = direct.select("query_id", F.col("id").alias("src")).distinct().join(step, "src")
    out = out.withColumn("_j", F.row_number().over(Window.partitionBy("query_id").orderBy("i", "src"))).where(F.col("_j") <= most)
    null = lambda t: F.lit(None).cast(t)
    kind = dict(candidates.dtypes)
    one = direct.select("query_id", null(kind["id"]).alias("origin"), "id", "target", "score", null("string").alias("type"))
    return one.unionByName(out.select("query_id", F.col("src").alias("origin"), F.col("dst").alias("id"), null(kind["target"]).alias("target"), null(kind["score"]).alias("score"), "type"))
