"""Audits of a graph's tables: missing values, unknown properties, repeated ids, coverage of vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """(label, property, total, absent, blank) for each required property, one pass over each table."""
    out = []
    for label, table in tables.items():
        counts = [x for c in required[label] for x in (F.count_if(F.col(c).isNull()).alias(f"{c}_absent"), F.count_if(F.trim(F.col(c).cast("string")) == "").alias(f"{c}_blank"))]
        one = table.agg(F.count("*").alias("total"), *counts)
        each = F.array(*(F.struct(F.lit(c).alias("property"), F.col(f"{c}_absent").alias("absent"), F.col(f"{c}_blank").alias("blank")) for c in required[label]))
        out.append(one.select(F.lit(label).alias("label"), "total", F.inline(each)))
    return reduce(DataFrame.unionByName, out).select("label", "property", "total", "absent", "blank")


def unexpected(nodes: DataFrame, allowed: list[str], props_col: str = "props", by: str = "label") -> DataFrame:
    """(label, property, n) of map properties that are not allowed."""
    keys = F.filter(F.map_keys(props_col), lambda k: ~k.isin(*allowed))
    return nodes.select(by, F.explode(keys).alias("property")).groupBy(by, "property").agg(F.count("*").alias("n"))


def repeated(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return nodes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def vector_coverage(nodes: DataFrame, vector_col: str = "embedding", by: str = "label") -> DataFrame:
    """(label, total, embedded, sizes) of each label."""
    return nodes.groupBy(by).agg(F.count("*").alias("total"), F.count(vector_col).alias("embedded"), F.array_sort(F.collect_set(F.size(vector_col))).alias("sizes"))


def document_warnings(documents: DataFrame, by: str = "id") -> DataFrame:
    """(by, warnings) of documents (by, code, issued, title, items): what a document lacks, in a fixed order; documents
    that lack nothing have an empty list. Blank counts as missing for texts, empty and null for items."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    lacks = (("thiếu mã văn bản", blank("code")), ("thiếu ngày ban hành", blank("issued")), ("thiếu tiêu đề", blank("title")), ("không có nội dung", F.coalesce(F.size("items"), F.lit(0)) <= 0))
    return documents.select(by, F.array_compact(F.array(*(F.when(c, F.lit(w)) for w, c in lacks))).alias("warnings"))


def extraction_warnings(documents: DataFrame, by: str = "id") -> DataFrame:
    """(by, warnings) of documents (by, code, issued, title, pages): what was not read from them, in a fixed order; a date that is
    only a year, or a year and a month, is a warning of its own. Null counts as empty and as no page."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    dated = F.when(blank("issued"), "không trích được ngày ban hành").when(F.col("issued").rlike(r"^\d{4}$"), "ngày ban hành chỉ có năm").when(F.col("issued").rlike(r"^\d{4}-\d{2}$"), "ngày ban hành chỉ có tháng và năm")
    found = (F.when(blank("code"), "không trích được mã văn bản"), dated, F.when(blank("title"), "không trích được tiêu đề"), F.when(F.coalesce("pages", F.lit(0)) <= 0, "tài liệu không có trang"))
    return documents.select(by, F.array_compact(F.array(*found)).alias("warnings"))


def item_counts(items: DataFrame, by: str, kinds: tuple[str, ...] = ("text", "table"), kind_col: str = "item") -> DataFrame:
    """(by, n of each kind, others): how many items of each kind a document has; a null kind is one of the others."""
    known = F.coalesce(F.col(kind_col).isin(*kinds), F.lit(False))
    return items.groupBy(by).agg(*(F.count_if(F.col(kind_col) == k).alias(f"n_{k}") for k in kinds), F.count_if(~known).alias("n_others"))


def unembedded(nodes: DataFrame, stored: DataFrame, size: int, force: bool = False, by: str = "id") -> DataFrame:
    """Nodes (by, text) with a text that lack a vector of the wanted size in stored (by, embedding); all of them by force."""
    some = nodes.where(F.trim("text") != "")
    if force:
        return some
    good = stored.where(F.size("embedding") == size).select(by)
    return some.join(good, by, "left_anti")
