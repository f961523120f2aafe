"""Cleaning of page items: letterheads, recipients, signatures, footers; tables across pages; footnotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lines of official letters that carry no content.
AGENCY = r"(?iU)^(?:PHÒNG|KHOA|VIỆN|TRUNG TÂM|TRƯỜNG)\s+[A-ZÀ-ỸĐ0-9&().,\-/ ]+$"
AGENCY_CONTINUED = r"(?iU)^(?:VÀ|&)(?:\s+[A-ZÀ-ỸĐ0-9&().,\-/]+){1,10}$"
LETTERHEADS = (
    r"^BỘ GIÁO DỤC VÀ ĐÀO TẠO$",
    r"^ĐẠI HỌC CẦN THƠ$",
    r"^TRƯỜNG ĐẠI HỌC CẦN THƠ$",
    r"^CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM$",
    r"^ĐỘC LẬP\s*[-–—]\s*TỰ DO\s*[-–—]\s*HẠNH PHÚC$",
    r"^BỘ GIÁO DỤC VÀ ĐÀO TẠO\s+CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM$",
    r"^(?:ĐẠI HỌC CẦN THƠ|TRƯỜNG ĐẠI HỌC CẦN THƠ)\s+ĐỘC LẬP\s*[-–—]\s*TỰ DO\s*[-–—]\s*HẠNH PHÚC$",
)
RECIPIENT = r"(?iU)^KÍNH\s+GỬI\s*:?"
FOOTER = r"(?iU)^NƠI\s+NHẬN\s*:?"
SIGNATURE = (
    r"(?iU)^(?:(?:KT|TL|TUQ|Q)\.?\s*)?"
    r"(?:HIỆU TRƯỞNG|PHÓ HIỆU TRƯỞNG|TRƯỞNG PHÒNG|PHÓ TRƯỞNG PHÒNG|GIÁM ĐỐC|PHÓ GIÁM ĐỐC|TRƯỞNG KHOA|PHÓ TRƯỞNG KHOA|VIỆN TRƯỞNG|PHÓ VIỆN TRƯỞNG)"
    r"(?:\s+(?:TRƯỜNG|KHOA|PHÒNG|VIỆN|TRUNG TÂM)\b[A-ZÀ-ỸĐ0-9&().,\-/ ]*)?$"
)
CLOSING = r"(?iU)^(?:TRÂN TRỌNG(?: KÍNH CHÀO)?|KÍNH CHÀO)\s*[./]*$"
PERSON = r"(?U)^[A-ZÀ-ỸĐ][a-zà-ỹđ]+(?:\s+[A-ZÀ-ỸĐ][a-zà-ỹđ]+){1,5}$"
NUMBER_OR_DATE = r"(?iU)^(?:SỐ\s*:?\s*(?=\d|/)|.*,\s*ngày\s)"
BULLET = r"^\s*[-+•*–]\s"


def all_caps(line: Column) -> Column:
    return (F.upper(line) == line) & line.rlike(r"\p{L}")


def content_lines(lines: DataFrame, by: list[str], order: str = "pos", text_col: str = "line", near_top: Column | None = None, near_bottom: Column | None = None) -> DataFrame:
    """The lines of letters that are content.

    Every mode is the last event so far: recipients run until a long line in mixed case, the letterhead's
    continuations follow an agency's name near the top, names go after a signer's title or near the bottom,
    and nothing counts from the footer on.
    """
    t = F.col(text_col)
    w = Window.partitionBy(*by).orderBy(order)
    at = lines.where(F.trim(text_col) != "")
    at = at.withColumn("_footer", F.max(t.rlike(FOOTER)).over(w)).where("NOT _footer")
    starts, ends = t.rlike(RECIPIENT), (F.length(t) >= 35) & ~all_caps(t) & ~t.rlike(BULLET)
    mode = F.last(F.when(starts, True).when(ends, False), ignorenulls=True).over(w)
    at = at.withColumn("_starts", starts).withColumn("_recipient", F.coalesce(mode, F.lit(False))).where("_starts OR NOT _recipient")
    agency = t.rlike(AGENCY) & all_caps(t)
    head = F.last(F.when(F.col("_starts"), False).when(agency, True).when(t.rlike(NUMBER_OR_DATE), False), ignorenulls=True).over(w)
    at = at.withColumn("_agency", agency).withColumn("_head", F.coalesce(head, F.lit(False))).withColumn("_signed", F.max(t.rlike(SIGNATURE)).over(w))
    top, bottom = near_top if near_top is not None else F.lit(True), near_bottom if near_bottom is not None else F.lit(False)
    drop = F.col("_starts") | F.col("_agency") | t.rlike("(?iU)" + "|".join(LETTERHEADS)) | (top & F.col("_head") & t.rlike(AGENCY_CONTINUED)) | t.rlike(SIGNATURE) | t.rlike(CLOSING) | (t.rlike(PERSON) & (F.col("_signed") | bottom))
    return at.where(~drop).select(*lines.columns)


def continued_tables(items: DataFrame, by: str = "file") -> DataFrame:
    """Tables (by, page, pos, headers, rows, title) with those that go on over pages as one: (by, page, pos, title, headers, rows, pages).

    A table that is the first item of its page goes on from the last item of the page before if that is a
    table of the same headers, unless it has another title of its own. Items are tables and texts (headers null).
    """
    w = Window.partitionBy(by).orderBy("page", "pos")
    at = items.withColumn("_sig", F.when(F.col("headers").isNotNull(), F.array_join(F.transform("headers", lambda h: F.lower(F.trim(F.coalesce(h, F.lit(""))))), "\u0001")))
    first = F.lag("page").over(w) == F.col("page") - 1
    own = (F.coalesce(F.trim("title"), F.lit("")) == "") | F.lower(F.trim("title")).eqNullSafe(F.lower(F.trim(F.lag("title").over(w))))
    joins = first & (F.col("_sig") == F.lag("_sig").over(w)) & own
    at = at.withColumn("_t", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w)).where(F.col("_sig").isNotNull())
    rows = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "pos", "rows"))), lambda x: x["rows"]))
    place = F.struct("page", "pos")
    return at.groupBy(by, "_t").agg(F.min(place).alias("p"), F.min_by("title", place).alias("title"), F.min_by("headers", place).alias("headers"), rows.alias("rows"), F.count_distinct("page").alias("pages")).select(by, "p.*", "title", "headers", "rows", "pages")


def footnotes(items: DataFrame, by: str = "doc_id") -> DataFrame:
    """Roman footnotes (by, pos, kind note or text, text) with the item they belong to: (by, pos, marker, ref_pos).

    That is the nearest text before the note with a word that carries the marker and stands in the note, too.
    """
    note = r"(?U)^\s*\(?([ivx]{1,4})\)?[.:)]?\s+(.+)$"
    notes = items.where(F.col("kind") == "note").select(by, "pos", F.regexp_extract("text", note, 1).alias("marker"), F.lower(F.regexp_extract("text", note, 2)).alias("body")).where("marker <> ''")
    marked = items.where(F.col("kind") == "text").select(F.col(by).alias("_d"), F.col("pos").alias("ref_pos"), F.explode(F.regexp_extract_all("text", F.lit(r"(?U)(\b\p{L}{2,}[ivx]{1,4})(?=\s*[,.;:]|\s+(?:và|hoặc|nhưng|thì)\b)"), F.lit(1))).alias("word"))
    hit = notes.join(marked, (F.col(by) == F.col("_d")) & (F.col("ref_pos") < F.col("pos")) & F.col("word").endswith(F.col("marker")))
    stem = F.lower(F.substring(F.col("word"), F.lit(1), F.length("word") - F.length("marker")))
    hit = hit.where((stem != "") & F.array_contains(F.split("body", r"(?U)\W+"), stem))
    return hit.groupBy(by, "pos", "marker").agg(F.max("ref_pos").alias("ref_pos"))
