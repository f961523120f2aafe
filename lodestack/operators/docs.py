"""Documents as ordered items: islands, carried titles, headings and section trees."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.blocks import stripped
from lodestack.functions.text import section, spaced


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, line) of every line."""
    return docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\\n")).alias("pos", "line"))


def carried(items: DataFrame, by: list[str], order: list[str], signature: Column, title: Column, out: str = "title") -> DataFrame:
    """Items with the last title so far among neighbours of one signature; where the signature changes it starts anew."""
    w = Window.partitionBy(*by).orderBy(*order)
    at = items.withColumn("_sig", signature)
    at = at.withColumn("_island", F.sum(F.when(F.col("_sig").eqNullSafe(F.lag("_sig").over(w)), 0).otherwise(1)).over(w))
    return at.withColumn(out, F.last(title, ignorenulls=True).over(Window.partitionBy(*by, "_island").orderBy(*order))).drop("_sig", "_island")


def merged_islands(items: DataFrame, by: list[str], order: str, joins: Column, text_col: str = "line", separator: str = " ") -> DataFrame:
    """Runs of items, each joined to the one before where ``joins`` holds: (by, first, n, text).

    ``joins`` reads the item and, as ``before``, the text of the one before it. It may look at the end of that
    text only: there the item before and all that has been joined to it are the same.
    """
    w = Window.partitionBy(*by).orderBy(order)
    at = items.withColumn("before", F.lag(text_col).over(w))
    at = at.withColumn("_island", F.sum(F.when(F.col("before").isNotNull() & F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t")))), lambda x: x["t"]), separator)
    return at.groupBy(*by, "_island").agg(F.min(order).alias("first"), F.count("*").alias("n"), text.alias("text")).drop("_island")


def continues(line: Column, before: Column) -> Column:
    """Whether a wrapped line goes on: the line before ends without a stop, and this one begins in lower case and is no heading or bullet."""
    return ~before.rlike(r"[.!?:;]\s*$") & line.rlike(r"^\s*\p{Ll}") & section(line).isNull() & ~line.rlike(r"^\s*[-+•*]\s")


def headings(items: DataFrame, by: str, order: str, text_col: str = "line") -> DataFrame:
    """Headings (by, order, symbol, level) of documents' lines."""
    return items.withColumn("_s", section(F.col(text_col))).where("_s is not null").select(by, order, F.col("_s.symbol").alias("symbol"), F.col("_s.level").alias("level"))


def parents(heads: DataFrame, by: str, order: str, deepest: int = 8) -> DataFrame:
    """Each heading's parent: the last one before it in its document with a smaller level (null: none).

    One running maximum for each level that is smaller, over one sort; deeper levels count as the deepest.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    level = F.least("level", F.lit(deepest))
    last = [F.max(F.when(level == k, F.col(order))).over(w) for k in range(1, deepest)]
    above = [F.when(level > k + 1, x) for k, x in enumerate(last)]
    return heads.withColumn("parent", F.greatest(F.lit(None).cast("int"), *above))


def section_trees(items: DataFrame, by: str, order: str, text_col: str = "line") -> DataFrame:
    """Sections of documents with ids and nesting: (by, id, parent_id, symbol, level, title, text); see ``hierarchy.trees``."""
    from lodestack.operators import hierarchy

    line = stripped(F.coalesce(F.col(text_col), F.lit("")))
    at = items.select(by, order, line.alias("said")).where("said <> ''").withColumn("_s", section(F.col("said")))
    return hierarchy.trees(at.select(by, order, "said", F.col("_s.symbol").alias("symbol"), F.col("_s.level").alias("level")), [by], order).drop("n_tables")


def numbered_ids(items: DataFrame, by: list[str], order: str, name: Column, out: str = "section_id") -> DataFrame:
    """Names made unique within a document: the second of a name gets _2, the third _3."""
    at = items.withColumn("_n", name)
    n = F.row_number().over(Window.partitionBy(*by, "_n").orderBy(order))
    return at.withColumn(out, F.when(n > 1, F.concat_ws("_", "_n", n.cast("string"))).otherwise(F.col("_n"))).drop("_n")


def page_text(html: Column) -> Column:
    """A page's text: scripts, styles, comments and head left out, blocks as lines, entities of markup resolved."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:/p|/h[1-6]|/li|/div|/tr|/article|/nav|br)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t\r]+", " ")
    return F.trim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"))


def reading_order(words: DataFrame, by: list[str]) -> DataFrame:
    """Words (block, line, word_no, x0, y0, x1, y1, text) as text items of blocks with their rectangles, in reading order."""
    from lodestack.functions.rects import rect, union

    ordered = lambda sep, key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, "text"))), lambda x: x["text"]), sep)
    at = words.where(F.trim("text") != "").groupBy(*by, "block", "line").agg(ordered(" ", ["word_no", "x0"]).alias("text"), *union(rect()))
    at = at.groupBy(*by, "block").agg(ordered("\n", ["line"]).alias("text"), *union(rect()))
    return at.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("y0", "x0", "block")))


def stages(docs: DataFrame) -> Iterator[tuple[str, DataFrame]]:
    """The steps from raw lines to section trees, for runs that write and restart at each."""
    at = lines(docs).withColumn("line", spaced(F.col("line"))).where("line <> ''")
    yield "lines", at
    at = merged_islands(at, ["doc_id"], "pos", continues(F.col("line"), F.col("before"))).select("doc_id", F.col("first").alias("pos"), F.col("text").alias("line"))
    yield "paragraphs", at
    yield "sections", section_trees(at, "doc_id", "pos")
