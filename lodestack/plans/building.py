"""Building the notices' tables from document trees: ids, filled tables, texts for embedding, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import text
from lodestack.operators import tables


def built(sections: DataFrame, titles: DataFrame) -> dict[str, DataFrame]:
    """The tables notices, sections, tables and rows of ``sources.files.sections()`` and (notice, title, file, issued).

    A table's cells are filled from above; a row's text is its notice, its section's text, its table's title
    and its cells under their headers. Ids name the path: notice, section, table and row.
    """
    named = titles.select(F.col("notice").alias("id"), "title", text.title_type(F.col("title")).alias("type"), "issued", text.file_period(F.col("file"), F.col("title")).alias("p"), text.date_parts(F.col("issued"))["y"].alias("y"))
    notices = named.select("id", "title", "type", "issued", F.nullif("y", F.lit(0)).alias("year"), "p.school_start", "p.school_end", "p.semester")
    own = sections.select(F.concat_ws("_", "notice", "id").alias("id"), F.col("notice").alias("notice_id"), F.when(F.col("parent_id").isNotNull(), F.concat_ws("_", "notice", "parent_id")).alias("parent_id"), "symbol", "text", "tables")
    at = own.select(F.col("id").alias("section_id"), "notice_id", F.col("text").alias("above"), F.posexplode("tables").alias("i", "t"))
    at = at.select(F.concat_ws("_", "section_id", F.lit("bang"), (F.col("i") + 1).cast("string")).alias("id"), "section_id", "notice_id", "above", (F.col("i") + 1).alias("seq"), F.trim(F.coalesce("t.tieu_de_bang", F.lit(""))).alias("title"), F.col("t.cot").alias("headers"), F.col("t.du_lieu").alias("rows"))
    cells = at.select(F.col("id").alias("table_id"), "notice_id", "above", "title", "headers", F.posexplode("rows").alias("i", "cells"))
    filled = tables.forward_filled(cells, ["table_id"], ["i"]).join(notices.select(F.col("id").alias("notice_id"), F.col("title").alias("notice")), "notice_id", "left")
    content = tables.row_text(F.col("headers"), F.col("cells"))
    rows = filled.select(F.concat_ws("_", "table_id", F.lit("dong"), (F.col("i") + 1).cast("string")).alias("id"), "table_id", (F.col("i") + 1).alias("seq"), "cells", tables.joined_parts(F.array("notice", "above", "title", content)).alias("text"))
    return {"notices": notices, "sections": own.drop("tables"), "tables": at.select("id", "section_id", "seq", "title", "headers"), "rows": rows}


def edges(parts: dict[str, DataFrame]) -> DataFrame:
    """Edges of the built tables, from the whole to its parts."""
    top = parts["sections"].select(F.coalesce("parent_id", "notice_id").alias("src"), F.col("id").alias("dst"), F.lit("CO_MUC").alias("type"))
    own = parts["tables"].select(F.col("section_id").alias("src"), F.col("id").alias("dst"), F.lit("CO_BANG").alias("type"))
    return top.unionByName(own).unionByName(parts["rows"].select(F.col("table_id").alias("src"), F.col("id").alias("dst"), F.lit("CO_DONG").alias("type")))


def counts(parts: dict[str, DataFrame]) -> DataFrame:
    """The import report's numbers: rows of each table by notice of origin are partial counts."""
    out = None
    for label, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def last_turns(conversations: DataFrame, n: int = 8) -> DataFrame:
    """The last n turns of each conversation as one text, roles but user and assistant as the user's, blank turns dropped afterwards."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    at = conversations.withColumn("r", F.row_number().over(w)).where((F.col("r") <= n) & (F.trim("text") != ""))
    line = F.concat_ws(": ", F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("user"), "text")
    return at.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("history"))
