"""Building documents from page items: wrapped lines, headings and bullets inside blocks, titles of tables, first items of pages.

All of it is windows over items in order. A block of text is exploded into its lines; what a line-by-line reader
would remember (how the run of lines began, whether a capital has already parted it) is a running value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import blocks
from lodestack.functions.text import spaced

# Ends of sentences, bullets, headings by structure, numbered headings, tails of an appendix's caption.
TERMINAL = r"""[.:;?!…]["”’')\]]*$"""
BULLET = r"(?iU)^\s*(?:[-+•▪◦‣–—]|\(\s*[a-zđ]\s*\)|[a-zđ]\s*[).])\s+"
STRUCTURE = (
    r"^\s*CHƯƠNG\s+(?:[IVXLCDM]+|\d+)\b",
    r"^\s*ĐIỀU\s+\d+\b",
    r"^\s*PHỤ\s+LỤC(?:\s+(?:[IVXLCDM]+|\d+))?\b",
    r"^\s*MỤC\s+(?:[IVXLCDM]+|\d+(?:\.\d+)*)\b",
    r"^\s*BƯỚC\s+\d+\b",
    r"^\s*(?:[IVXLCDM]+)\s*[.)]\s+\S",
    r"^\s*\d+(?:\.\d+)+\s*[.)]?\s+\S",
    r"^\s*\d+\s*[.)]\s+\S",
)
NUMBERED = r"(?U)^\s*\d+(?:\.\d+)*(?:\.|\))\s+\S"
CAPTION_TAIL = r"(?iU)^\s*của\s+(?:Hiệu trưởng|Giám đốc|Rector)\b.*\)\s*$"
APPENDIX = r"(?iU)\b(?:PHỤ LỤC|DANH SÁCH)\b"
BULLET_MARK = r"(?U)^\s*[-+•▪◦‣–—]\s*"
#: Ends of paragraphs that lead to a table, and kinds of blocks.
TABLE_INTROS = ("như sau:", "cụ thể như sau:", "theo bảng sau:", "được thể hiện trong bảng sau:")
HEADS = ("heading", "tieu_de")
TYPE_LINE = r"(?iU)^THÔNG\s+BÁO$"


def is_structural(line: Column) -> Column:
    return line.rlike("(?iU)" + "|".join(STRUCTURE))


def is_bullet(line: Column) -> Column:
    return line.rlike(BULLET)


def _first_letter(line: Column, kind: str) -> Column:
    """Whether the first letter, with no digit before it, is of a Unicode class."""
    return line.rlike(rf"^[^\p{{L}}\p{{Nd}}]*\p{{{kind}}}")


def joined(left: Column, right: Column) -> Column:
    """Two pieces of a wrapped text as one: a hyphen at the end goes if a small letter follows, stays without a blank otherwise."""
    wrapped = left.rlike(r"(?<! )-$") & ~(left.rlike(r"\d-$") & right.rlike(r"^\d")) & _first_letter(right, "Ll") & ~is_bullet(right)
    return (
        F.when(left == "", right).when(right == "", left).when(wrapped, F.concat(F.substring(left, F.lit(1), F.length(left) - 1), right))
        .when(left.endswith("-") & ~is_bullet(right), F.concat(left, right)).otherwise(F.concat_ws(" ", left, right))
    )


def _folded(pieces: Column) -> Column:
    """Pieces in order, joined one after the other."""
    return F.aggregate(pieces, F.lit(""), joined)


def _ordered(order: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])


def segments(items: DataFrame, by: list[str], order: str, text_col: str = "text", kind_col: str = "kind") -> DataFrame:
    """Blocks (by, order, text, kind, y0, y1) as typed pieces: (by, order, seg, kind, text, y0, y1).

    First lines that were wrapped are joined: a line goes on from the one before unless a blank line or the end of a
    sentence parts them, it is a heading by structure or a bullet, or it begins with a capital right below a numbered
    heading. Of what is left, headings and bullets are pieces of their own, lines between them one piece of the block's
    kind; a block of one line is a heading or keeps its kind. A piece has the share of the block's height that its
    lines have. Blank blocks have no pieces.
    """
    key = [*by, order]
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r\n|\r|\n")
    at = items.select(*key, F.coalesce(kind_col, F.lit("")).alias("_base"), "y0", "y1", F.size(lines).alias("_size"), F.posexplode(lines).alias("_i", "line")).withColumn("line", spaced(F.col("line")))
    w = Window.partitionBy(*key).orderBy("_i")
    before, line = F.lag("line").over(w), F.col("line")
    at = at.withColumn("_before", before).where("line <> ''")
    parts = F.col("_before").isNull() | (F.col("_before") == "") | is_structural(line) | is_bullet(line) | F.col("_before").rlike(TERMINAL)
    at = at.withColumn("_run", F.sum(parts.cast("int")).over(w))
    run = Window.partitionBy(*key, "_run").orderBy("_i")
    at = at.withColumn("_after", F.row_number().over(run) > 1).withColumn("_upper", F.col("_after") & _first_letter(line, "Lu"))
    capitals = F.sum(F.col("_upper").cast("int")).over(run)
    parted = F.first(line.rlike(NUMBERED)).over(run) & F.col("_upper") & (capitals == 1)
    at = at.withColumn("_whole", F.sum((~F.col("_after") | parted).cast("int")).over(w))
    at = at.groupBy(*key, "_base", "y0", "y1", "_size", "_whole").agg(_folded(_ordered("_i", "line")).alias("line"), F.min("_i").alias("_from"), F.max("_i").alias("_to"))
    alone = F.count("*").over(Window.partitionBy(*key)) == 1
    kind = F.when(is_structural(line), "heading").when(alone, F.col("_base")).when(is_bullet(line), "bullet")
    at = at.withColumn("_kind", kind).withColumn("_alone", alone)
    w = Window.partitionBy(*key).orderBy("_from")
    at = at.withColumn("_last", F.lag("_kind", 1, "heading").over(w)).withColumn("_head", F.last(F.col("_kind") == "heading", ignorenulls=True).over(w))
    at = at.withColumn("seg", F.sum((F.col("_kind").isNotNull() | F.col("_last").isNotNull()).cast("int")).over(w))
    at = at.withColumn("_n", F.row_number().over(w))
    pieces = _ordered("_from", "line")
    # below a heading lines are set side by side, elsewhere they are joined as wrapped ones
    text = F.when(F.coalesce(F.max(F.col("_kind").isNull() & F.col("_head")), F.lit(False)), F.array_join(pieces, " ")).otherwise(_folded(pieces))
    share = lambda c: F.col("y0") + (F.col("y1") - F.col("y0")) * c / F.col("_size")
    out = at.groupBy(*key, "_base", "y0", "y1", "_size", "seg").agg(F.max("_kind").alias("kind"), text.alias("text"), F.min("_from").alias("_top"), F.max("_to").alias("_end"))
    return out.select(*key, "seg", F.coalesce("kind", F.when(F.col("_base") != "", F.col("_base")), F.lit("doan_van")).alias("kind"), "text", share(F.col("_top")).alias("y0"), share(F.col("_end") + 1).alias("y1"))


def content(pieces: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Pieces and tables (by, order, item text or table, kind, text) in order, texts that go on from the one before joined:
    (by, first, item, kind, text, n).

    Neither of them may be a heading or a title; the later may be no bullet and no heading by structure, and the
    earlier may not end a sentence. The tail of an appendix's caption goes if it follows that title.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    text, is_text = spaced(F.col("text")), F.col("item") == "text"
    at = pieces.withColumn("text", F.when(is_text, text)).where(~is_text | (F.col("text") != ""))
    tail = is_text & F.col("text").rlike(CAPTION_TAIL)
    title = F.last(F.when(~tail, is_text & (F.col("kind") == "tieu_de") & F.coalesce(F.col("text").rlike(APPENDIX), F.lit(False))), ignorenulls=True).over(w)
    at = at.withColumn("_gone", tail & F.coalesce(title, F.lit(False))).where("NOT _gone").drop("_gone")
    last = F.lag(F.struct("item", "kind", "text")).over(w)
    at = at.withColumn("_l", last).withColumn("_n", F.row_number().over(w))
    goes_on = is_text & (F.col("_l.item") == "text") & ~F.col("_l.kind").isin(*HEADS) & ~F.col("kind").isin(*HEADS) & ~is_structural(F.col("text")) & ~is_bullet(F.col("text")) & ~F.col("_l.text").rlike(TERMINAL)
    at = at.withColumn("_g", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w))
    first = lambda c: F.min_by(c, "_n").alias(c)
    return at.groupBy(*by, "_g").agg(F.min("_n").alias("first"), first("item"), first("kind"), _folded(_ordered("_n", "text")).alias("text"), F.count("*").alias("n")).drop("_g")


def is_main_title(kind: Column, page: Column, text: Column, title: Column) -> Column:
    """Whether a block on the first page is the document's title, which is told elsewhere: a title that is no appendix, and
    without its type line empty or overlapping with the document's title."""
    rest = F.array_join(F.filter(blocks.lines(text), lambda x: ~x.rlike(TYPE_LINE)), " ")
    same = F.when(blocks.comparison_key(rest) == "", F.lit(True)).otherwise(blocks.titles_overlap(rest, title))
    return (kind == "tieu_de") & (page == 1) & ~F.coalesce(text, F.lit("")).rlike(APPENDIX) & same


def meaningful(items: DataFrame, by: str, titles: DataFrame) -> DataFrame:
    """Items (by, page, pos, item, kind, text) that are content, with ``starts_page``: no metadata, no main title of the document
    (by, doc_title), no blank text. The first of them on a page starts it."""
    at = items.join(titles.select(by, "doc_title"), by, "left")
    text = F.col("item") == "text"
    drop = text & ((F.col("kind") == "metadata") | is_main_title(F.col("kind"), F.col("page"), F.col("text"), F.col("doc_title")) | (spaced(F.col("text")) == ""))
    at = at.where(~F.coalesce(drop, F.lit(False)))
    return at.withColumn("starts_page", F.row_number().over(Window.partitionBy(by, "page").orderBy("pos")) == 1)


def table_titles(items: DataFrame, by: str, order: str = "pos") -> DataFrame:
    """Tables (by, order, title, inferred, found) of items (by, order, item, kind, text, title, doc_title) with the title that they get.

    Going back from a table, the first item counts that is not passed over: a heading or a bullet gives its text, a
    title that names an appendix, too; another table or a paragraph gives none. Passed over are blank texts, what
    overlaps with the document's title, other titles, and paragraphs that lead to a table. That title is taken where
    the table has none, or only the document's; that one is taken away where there is nothing better.
    """
    text, kind = spaced(F.col("text")), F.lower(F.col("kind"))
    own = spaced(F.col("title"))
    leads = F.lower(text).rlike("(?:" + "|".join(TABLE_INTROS) + ")$")
    passed = (text == "") | blocks.titles_overlap(text, F.col("doc_title")) | (kind.isin("doan_van", "ghi_chu") & leads) | ((kind == "tieu_de") & ~text.rlike(APPENDIX))
    value = F.when(kind == "bullet", F.trim(F.regexp_replace(text, BULLET_MARK, ""))).when(kind.isin(*HEADS), text).otherwise("")
    mark = F.when(F.col("item") == "table", "").when(~passed, value)
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = items.withColumn("_mark", mark).withColumn("inferred", F.coalesce(F.last("_mark", ignorenulls=True).over(w), F.lit(""))).where(F.col("item") == "table")
    like = blocks.titles_overlap(own, F.col("doc_title"))
    found = F.when((F.col("inferred") != "") & ((own == "") | like), F.col("inferred")).when(like, "").otherwise(own)
    return at.select(by, order, "title", "inferred", found.alias("found"))
