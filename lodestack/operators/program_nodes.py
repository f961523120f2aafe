"""Sections of a program's document as typed nodes and edges: decisions, levels, units, objectives, jobs, further study, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import first_group, slug

# Types of legal documents, in texts and at their begin; words that make a reference a legal one.
LEGAL = r"(?iu)(Quyết định|Thông tư|Nghị quyết|Luật|Nghị định|Chỉ thị|Thông báo)"
LEGAL_START = r"(?iu)^(Quyết định|Thông tư|Nghị định|Luật|Hiến pháp|Chỉ thị|Nghị quyết)"
LEGAL_WORDS = r"thông tư|quyết định|luật|nghị định|nghị quyết"
# Number, agency and what follows it, dates, level, units, objectives, links.
NUMBER = r"(?U)(?:số|Số)\s*[:.\-]?\s*([\w\d\-/.]+)"
REFERENCE_NUMBER = r"(?iu)số \s*([^\s)]+)"
AGENCY = r"(?iu)của\s+(.+?)\s+(về|ban hành|phê duyệt|quy định|thông qua)"
SUBJECT = r"(?isu)của\s+.+?\s+((?:về|ban hành|phê duyệt|quy định|thông qua).*)$"
AGENCY_ALONE = r"(?iu)của\s+([^)_]+)"
DATE_WORDS = r"(?iu)ngày\s+(\d+)\s+tháng\s+(\d+)\s+năm\s+(\d+)"
DATE_DIGITS = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
LEVEL = r"(?iu)TRÌNH\s+ĐỘ\s+([A-ZÀ-Ỹ\s]+?)(?=\s*\(|\s*$)"
UNIT = r"(?iu)Đơn vị quản lý:\s*(.+)"
SUBUNIT, FACULTY = r"(?iu)Bộ môn\s+([^-\n]+)", r"(?iu)Khoa\s+([^,\n-]+)"
OBJECTIVE = r"(?:\s|^)[a-z0-9]{1,2}[.)]?\s+(.*?)\((PEO\s*\d+)\)"
LINK_IN_BRACKETS, LINK = r"\(\s*(https?://[^)]+)\s*\)", r"https?://\S+(?:\s\S+)*"
#: Concepts whose items are nodes: type, middle of the id, edge.
LISTED = {"VI_TRI_VIEC_LAM": ("ViTriViecLam", "vtvl", "CO_CO_HOI_VIEC_LAM"), "KHA_NANG_HOC_TAP": ("KhaNangHocTap", "knht", "TAO_NEN_TANG")}


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def _line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def items(text: Column) -> Column:
    """The items of a list, each on one line without its bullet."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\n-|\n\+"), lambda x: _line(F.regexp_replace(x, r"^[+-]\s*", "")))


def _date(text: Column, default: str) -> Column:
    def one(pattern: str) -> Column:
        d, m, y = (first_group(text, pattern, g) for g in (1, 2, 3))
        pad = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
        return F.when(d.isNotNull(), F.concat_ws("/", pad(d), pad(m), y))

    return F.coalesce(one(DATE_WORDS), one(DATE_DIGITS), F.lit(default))


def _agency(text: Column) -> Column:
    return F.coalesce(F.trim(first_group(text, AGENCY)), F.trim(first_group(text, AGENCY_ALONE)))


_NODE = ("program", "type", "id", "name", "kind", "issued", "agency", "link", "edge_type", "source")


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    empty = F.lit(None).cast("string")
    return df.select(*(columns.get(c, F.col(c) if c in df.columns else empty).cast("string").alias(c) for c in _NODE))


def found(sections: DataFrame) -> DataFrame:
    """Of sections (program, major, concept, text) what each says: (program, type, id, name, kind, issued, agency, link, edge_type, source).

    Concepts are QUYET_DINH, DON_VI, MUC_TIEU, VI_TRI_VIEC_LAM, KHA_NANG_HOC_TAP and THAM_KHAO; others say nothing. A row is
    a node and the edge that leads to it from ``source``, the program or for units the major. Ids of legal documents, levels
    and units are made from their numbers and names, so that programs share them.
    """
    t, program = F.col("text"), F.col("program")
    of = lambda c: sections.where(F.col("concept") == c)
    d = of("QUYET_DINH").withColumn("text", F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"^#+\s+", "")))
    number = first_group(t, NUMBER)
    subject = F.coalesce(_capital(F.trim(first_group(t, SUBJECT))), F.lit(""))
    decision = _rows(d, type=F.lit("VanBanPhapLy"), id=F.coalesce(slug(number), F.lit("UNKNOWN")), name=subject, kind=F.coalesce(first_group(t, LEGAL), F.lit("")), issued=_date(t, "01/01/1900"), agency=F.coalesce(_agency(t), F.lit("")), edge_type=F.lit("DUOC_BAN_HANH_THEO"), source=program)
    level_name = F.coalesce(F.trim(first_group(t, LEVEL)), F.lit("Unknown"))
    level = _rows(d, type=F.lit("TrinhDo"), id=slug(level_name), name=level_name, edge_type=F.lit("DAO_TAO_TRINH_DO"), source=program)
    u = of("DON_VI").withColumn("unit", F.coalesce(F.trim(first_group(t, UNIT)), F.lit("Unknown")))
    sub, faculty = F.trim(first_group(F.col("unit"), SUBUNIT)), F.coalesce(F.trim(first_group(F.col("unit"), FACULTY)), F.lit("Unknown"))
    unit = _rows(u, type=F.when(sub.isNotNull(), "BoMon").otherwise("Khoa"), id=slug(F.coalesce(sub, faculty)), name=F.coalesce(sub, faculty), edge_type=F.lit("THUOC_VE"), source=F.col("major"))
    # objectives: parts under headers of three marks, general ones whole, others by their numbers
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(t, F.lit(""))), r"\n###\s+")
    o = of("MUC_TIEU").select("program", "major", F.size(parts).alias("n"), F.posexplode(parts).alias("i", "part"))
    o = o.where((F.col("n") == 1) | (F.col("i") > 0)).withColumn("head", F.when(F.col("n") > 1, F.lower(F.substring_index("part", "\n", 1)))).withColumn("body", F.when(F.col("n") > 1, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part")))
    common = F.coalesce(F.contains("head", F.lit("chung")), F.lit(True))
    general = _rows(o.where(common), type=F.lit("MucTieuDaoTao"), id=F.concat(program, F.lit("_chung")), name=_line(F.col("body")), kind=F.lit("Chung"), edge_type=F.lit("CO_MUC_TIEU_DAO_TAO"), source=program)
    one = o.where(~common).select("program", "major", F.explode(F.regexp_extract_all(_line(F.col("body")), F.lit(OBJECTIVE), F.lit(0))).alias("m"))
    title = F.trim(F.regexp_replace(F.trim(F.regexp_extract("m", OBJECTIVE, 1)), r"[,;.]+$", ""))
    specific = _rows(one, type=F.lit("MucTieuDaoTao"), id=F.concat(program, F.lit("_"), F.replace(F.regexp_extract("m", OBJECTIVE, 2), F.lit(" "), F.lit(""))), name=title, kind=F.lit("CuThe"), edge_type=F.lit("CO_MUC_TIEU_DAO_TAO"), source=program)
    listed = []
    for concept, (kind, middle, edge) in LISTED.items():
        at = of(concept).select("program", "major", F.posexplode(items(t)).alias("i", "item"))
        listed.append(_rows(at, type=F.lit(kind), id=F.concat(program, F.lit(f"_{middle}_"), (F.col("i") + 1).cast("string")), name=F.col("item"), edge_type=F.lit(edge), source=program))
    r = of("THAM_KHAO").select("program", "major", F.posexplode(items(t)).alias("i", "item")).withColumn("legal", F.lower("item").rlike(LEGAL_WORDS))
    i = F.col("item")
    own = first_group(i, LEGAL_START)
    law = _rows(r.where("legal"), type=F.lit("VanBanPhapLy"), id=slug(F.coalesce(first_group(i, REFERENCE_NUMBER), F.lit("Unknown"))), name=F.coalesce(_capital(F.trim(first_group(i, SUBJECT))), i), kind=F.coalesce(own, F.lit("Văn bản")), issued=_date(i, ""), agency=F.coalesce(_agency(i), F.lit("Không xác định")), edge_type=F.lit("TUAN_THU"), source=program)
    from pyspark.sql import Window

    bare = r.where("NOT legal").withColumn("k", F.row_number().over(Window.partitionBy("program").orderBy("i")))
    bracket, free = first_group(i, LINK_IN_BRACKETS, 0), first_group(i, LINK, 0)
    removed = F.coalesce(bracket, free, F.lit(""))
    link = F.coalesce(F.regexp_replace(F.regexp_replace(first_group(i, LINK_IN_BRACKETS), r"\s+", ""), r"^[.,;?]+|[.,;?]+$", ""), F.regexp_replace(F.regexp_replace(free, r"\s+", ""), r"^[).,;?]+|[).,;?]+$", ""), F.lit(""))
    rest = F.regexp_replace(_line(F.when(removed != "", F.replace(i, removed, F.lit(""))).otherwise(i)), r"^[ :.,;]+|[ :.,;]+$", "")
    cited = _rows(bare, type=F.lit("ChuanThamKhao"), id=F.concat(program, F.lit("_ctk_"), F.col("k").cast("string")), name=rest, link=link, edge_type=F.lit("THAM_CHIEU"), source=program)
    return reduce(DataFrame.unionByName, [decision, level, unit, general, specific, *listed, law, cited])


def nodes(rows: DataFrame) -> DataFrame:
    """One node for each (type, id), as the first program by id says it."""
    first = F.min(F.struct("program", "name", "kind", "issued", "agency", "link")).alias("x")
    return rows.groupBy("type", "id").agg(first, F.count_distinct("program").alias("programs")).select("type", "id", "x.name", "x.kind", "x.issued", "x.agency", "x.link", "programs")


def edges(rows: DataFrame) -> DataFrame:
    """Distinct edges (src, type, dst)."""
    return rows.select(F.col("source").alias("src"), F.col("edge_type").alias("type"), F.col("id").alias("dst")).distinct()
