"""From a file's items in order to documents and nested sections, by windows over the items: no state outside Spark.

What a parser keeps as state is here the last event so far (whether a numbered note goes on, which document is
open), a running count (which section), or the last of each level (the stack of open sections).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import blocks
from lodestack.functions.text import section

# How notes begin that number their own lines, and kinds of items.
NOTE_STARTS = ("lưu ý", "ghi chú", "chú thích")
NOTE_KIND, HEADING_KIND = "ghi_chu", "heading"
#: Levels that are told apart; a number of more parts counts as one of so many.
DEEPEST = 16


def lexed(items: DataFrame, by: str, order: str = "pos", overlap: Callable[[Column, Column], Column] = blocks.titles_overlap, strip: Callable[[Column], Column] = blocks.stripped, starts: Callable[[Column, Column], Column] = blocks.document_start, heading: Column | None = None) -> DataFrame:
    """Items (by, order, item text or table, kind, text, title) with ``doc_no``, ``symbol`` and ``level`` of headings, and ``said``, the
    text that each adds.

    Blank texts go. A note that begins with one of ``NOTE_STARTS`` goes on until a heading by kind or a new document; numbered
    lines within it are text. A text that looks like a document's start begins a new one unless it is the file's first
    item; so does a table whose title does, if the title has not just been said as text, nor as the document's or an
    earlier such table's title. ``overlap`` tells whether one title says another, null for no; ``strip`` takes
    blanks off the ends of texts; ``starts`` tells whether a text of a kind begins a document; ``heading`` is a text's struct(symbol, level) where that is known already, null for none.
    """
    text, kind, title = strip(F.coalesce("text", F.lit(""))), F.lower(F.trim(F.coalesce("kind", F.lit("")))), strip(F.coalesce("title", F.lit("")))
    table = F.col("item") == "table"
    at = items.select("*", text.alias("_text"), kind.alias("_kind"), title.alias("_title")).where(table | (F.col("_text") != ""))
    at = at.withColumn("_s", F.when(~table, section(F.col("_text")) if heading is None else heading)).withColumn("_begins", ~table & starts(F.col("_text"), F.col("_kind")))
    w = Window.partitionBy(by).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    note = ~table & (F.col("_kind") == NOTE_KIND) & F.lower("_text").rlike("^(?:" + "|".join(NOTE_STARTS) + ")")
    closes = F.col("_begins") | (F.col("_s").isNotNull() & (F.col("_kind") == HEADING_KIND))
    at = at.withColumn("_first", F.row_number().over(w) == 1).withColumn("_note", note)
    at = at.withColumn("_noted", F.col("_note") | F.coalesce(F.last(F.when(F.col("_note"), True).when(closes, False), ignorenulls=True).over(before), F.lit(False)))
    at = at.withColumn("_head", F.col("_s").isNotNull() & (~F.col("_noted") | (F.col("_kind") == HEADING_KIND))).withColumn("_begins", F.col("_begins") & ~F.col("_head"))
    listed = table & ~F.col("_first") & starts(F.col("_title"), F.lit(""))
    at = at.withColumn("_listed", listed)
    spoken = F.last(F.when(F.col("_listed"), F.col("_title")).when(~table, F.col("_text")), ignorenulls=True).over(before)
    named = F.last(F.when(F.col("_listed"), F.col("_title")).when(F.col("_begins"), F.col("_text")), ignorenulls=True).over(before)
    at = at.withColumns({"_spoken": spoken, "_named": named})
    opens = F.col("_listed") & ~F.coalesce(overlap(F.col("_spoken"), F.col("_title")), F.lit(False)) & ~F.coalesce(overlap(F.col("_named"), F.col("_title")), F.lit(False))
    at = at.withColumn("_opens", opens).withColumn("doc_no", 1 + F.sum((F.col("_opens") | (F.col("_begins") & ~F.col("_first"))).cast("int")).over(w))
    said = F.when(F.col("_opens"), F.col("_title")).when(~table, F.col("_text"))
    return at.select(*items.columns, "doc_no", F.when(F.col("_head"), F.col("_s.symbol")).alias("symbol"), F.when(F.col("_head"), F.col("_s.level")).alias("level"), said.alias("said"))


def trees(events: DataFrame, keys: list[str], order: str, is_table: Column | None = None, deepest: int = DEEPEST) -> DataFrame:
    """Nested sections of ``events`` (keys, order, symbol, level, said): (keys, id, parent_id, symbol, level, title, text, n_tables).

    A heading (symbol not null) closes all sections at its level or below, and lies within the last that is open. The
    first section of a document has level 1, whatever its number, so that one of level 1 is always open; texts before
    the first heading are a section without a symbol. Symbols that repeat within a document get _2, _3 and so on. A
    document is one partition of a window, sorted once.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    head = F.col("symbol").isNotNull()
    at = events.withColumn("_table", is_table if is_table is not None else F.lit(False)).withColumn("_n", F.row_number().over(w))
    at = at.withColumn("_sec", F.sum((head | (F.col("_n") == 1)).cast("int")).over(w))
    lines = F.array_sort(F.collect_list(F.when(~head & F.col("said").isNotNull(), F.struct(F.col(order).alias("o"), "said"))))
    sections = at.groupBy(*keys, "_sec").agg(
        F.max("symbol").alias("symbol"), F.max("level").alias("_level"), F.coalesce(F.max(F.when(head, F.col("said"))), F.lit("")).alias("title"),
        F.array_join(F.transform(lines, lambda x: x["said"]), "\n").alias("text"), F.count_if("_table").alias("n_tables"),
    )
    name = F.coalesce("symbol", F.lit("0"))
    level = F.when(F.col("_sec") == 1, 1).otherwise(F.least("_level", F.lit(deepest)))
    again = F.row_number().over(Window.partitionBy(*keys, "_name").orderBy("_sec"))
    sections = sections.withColumn("_name", name).withColumn("level", level.cast("int")).withColumn("_again", again)
    sections = sections.withColumn("id", F.when(F.col("_again") > 1, F.concat_ws("_", "_name", F.col("_again").cast("string"))).otherwise(F.col("_name")))
    before = Window.partitionBy(*keys).orderBy("_sec").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.struct("_sec", "id"))).over(before) for k in range(1, deepest)]
    above = [F.when(F.col("level") > k, x) for k, x in enumerate(last, 1)]
    parent = F.greatest(*above)["id"]
    return sections.select(*keys, "id", parent.alias("parent_id"), F.coalesce("symbol", F.lit("")).alias("symbol"), "level", "title", "text", "n_tables")
