"""Items of pages: text beside tables, numbers that lie over a letter's head, titles of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import blocks, rects

# Lines that hold a subject, and first lines of blocks that title an appendix.
SUBJECT_LINE = r"(?iU)^(?:V\s*/\s*v|Về\s+việc)\s*[:\-]?\s*(.+)$"
APPENDIX = r"(?iU)^(?:PHỤ\s+LỤC|DANH\s+SÁCH)\b"
FILE_SUBJECT = r"(?iU)(?:thông báo|về việc|v/v)\s+(.+)$"


def outside_tables(items: DataFrame, tables: DataFrame, by: list[str], pad: float = 1.0, share: float = 0.9) -> DataFrame:
    """Items (by, x0, y0, x1, y1) that lie in no table of their page: in one lie those whose centre does, and of their
    area the share or more. Tables are padded on each side. Empty items have no share and stay."""
    grown = [F.col("x0") - pad, F.col("y0") - pad, F.col("x1") + pad, F.col("y1") + pad]
    other = tables.select(*(F.col(c).alias(f"t_{c}") for c in by), *(g.alias(f"t_{c}") for g, c in zip(grown, ("x0", "y0", "x1", "y1"))))
    inside = rects.centre_in(rects.rect(), rects.rect("t_")) & (rects.overlap(rects.rect(), rects.rect("t_")) >= share)
    for c in by:
        inside = inside & (F.col(c) == F.col(f"t_{c}"))
    return items.join(other, inside, "left_anti")


def _height(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two spans by the shorter one, which counts as 1 at least."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / F.greatest(F.lit(1.0), F.least(a1 - a0, b1 - b0))


def without_overlays(items: DataFrame, by: list[str], order: str = "pos", text_col: str = "text") -> DataFrame:
    """Items (by, order, text, x0, y0, x1, y1) without numbers that a signature lays over the number of a letter.

    Items with a letter's number become metadata (``is_metadata``) and lose lines of digits alone below the first.
    Each in order takes the best item of up to three lines of digits that is left on its page, by overlap in height
    and then nearness; that item goes, and the metadata's rectangle grows by it. Of equal scores the later item.
    Only these few items of a page are gathered; the others pass by.
    """
    rows, digits = blocks.lines(F.col(text_col)), lambda x: x.rlike(blocks.ONLY_NUMBER)
    at = items.withColumn("_lines", rows).withColumn("is_metadata", F.exists("_lines", lambda x: x.rlike(blocks.NUMBER)))
    over = ~F.col("is_metadata") & F.size("_lines").between(1, 3) & F.forall("_lines", digits)
    box = F.struct(F.col(order).alias("pos"), *("y0", "y1", "x0", "x1"))
    page = at.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("is_metadata"), box))).alias("m"), F.array_sort(F.collect_list(F.when(over, box))).alias("o"))
    page = page.where((F.size("m") > 0) & (F.size("o") > 0))

    def taken(done: Column, m: Column) -> Column:
        apart = lambda o: F.abs((m["y0"] + m["y1"]) / 2 - (o["y0"] + o["y1"]) / 2)
        common = lambda o: _height(m["y0"], m["y1"], o["y0"], o["y1"])
        free = F.filter("o", lambda o: ~F.exists(done, lambda d: d["o"]["pos"] == o["pos"]) & ((common(o) > 0) | (apart(o) <= 20)))
        best = F.array_max(F.transform(free, lambda o: F.struct((common(o) * 10 - apart(o) / 100).alias("score"), o.alias("o"))))
        ranked = F.struct(m["pos"].alias("m"), best["o"].alias("o"))
        return F.when(best.isNull(), done).otherwise(F.concat(done, F.array(ranked)))

    kind = dict(at.select(box.alias("b")).dtypes)["b"]
    none = F.array().cast(f"array<struct<m:{dict(at.dtypes)[order]},o:{kind}>>")
    pairs = page.select(*by, F.explode(F.aggregate("m", none, taken)).alias("p"))
    key = [*by, order]
    gone = pairs.select(*by, F.col("p.o.pos").alias(order))
    grown = pairs.select(*by, F.col("p.m").alias(order), *(F.col(f"p.o.{c}").alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    out = at.join(gone, key, "left_anti").join(grown, key, "left")
    text = F.when(F.col("is_metadata"), F.array_join(F.concat(F.slice("_lines", 1, 1), F.filter(F.slice("_lines", 2, 1 << 30), lambda x: ~digits(x))), "\n")).otherwise(F.col(text_col))
    sides = {c: f(c, F.coalesce(F.col(f"_{c}"), F.col(c))) for c, f in (("x0", F.least), ("y0", F.least), ("x1", F.greatest), ("y1", F.greatest))}
    return out.withColumns({text_col: text, **sides}).select(*items.columns, "is_metadata")


def _subject(line: Column) -> Column:
    """The subject of a line as a title, null if it has none."""
    title = F.regexp_extract(line, SUBJECT_LINE, 1)
    return F.when(title != "", F.concat(F.lit("Về việc "), blocks.stripped(title)))


def titles(items: DataFrame, files: DataFrame, by: str = "doc", order: str = "pos") -> DataFrame:
    """(by, title) for files (by, name) with items (by, order, kind, text): the first line with a subject, metadata
    before the rest; else the first block of kind tieu_de that is no appendix, without the words THÔNG BÁO alone and
    lines in brackets; else the subject in the file's name; else empty."""
    rows = blocks.lines(F.col("text"))
    at = items.select(by, order, "kind", rows.alias("rows"))
    subject = F.get(F.array_compact(F.transform("rows", _subject)), F.lit(0))
    plain = F.filter("rows", lambda x: (F.upper(F.regexp_replace(x, r"[ \t]+", " ")) != "THÔNG BÁO") & ~x.startswith("("))
    block = F.when((F.col("kind") == "tieu_de") & ~F.coalesce(F.get("rows", F.lit(0)).rlike(APPENDIX), F.lit(True)), F.nullif(F.array_join(F.transform(plain, lambda x: F.coalesce(_subject(x), x)), " "), F.lit("")))
    at = at.select(by, order, "kind", subject.alias("subject"), block.alias("block"))
    best = lambda c, *o: F.min(F.when(F.col(c).isNotNull(), F.struct(*o, F.col(c).alias("v"))))["v"]
    found = at.groupBy(by).agg(best("subject", (F.col("kind") != "metadata").alias("late"), order).alias("subject"), best("block", order).alias("block"))
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace("name", r"^.*/", ""), r"(?<=.)\.[^.]*$", ""), r"(?i)(?:\.signed)+$", "")
    spaced = F.trim(F.regexp_replace(stem, r"(?U)[_\s]+", " "))
    named = F.nullif(F.regexp_extract(spaced, FILE_SUBJECT, 1), F.lit(""))
    return files.join(found, by, "left").select(by, F.coalesce("subject", "block", F.concat(F.lit("Về việc "), named), F.lit("")).alias("title"))
