"""Blocks of text on pages: what a block is, how lines go on, where documents begin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.text import let

# How blocks of official letters begin.
NUMBER = r"(?iU)^SỐ\s*:?\s*(?=\d|/)"
DATE = r"(?iU)^CẦN THƠ\s*,?\s*NGÀY\b"
LIST_SUMMARY = r"(?iU)^Danh\s+sách\s+có\s*:"
NOTE = r"(?iU)^(?:LƯU Ý|GHI CHÚ|CHÚ THÍCH)\s*:"
FOOTNOTE = r"(?iU)^[ivxlcdm]+\s+\S"
BULLET = r"(?U)^\s*[-–—•+]"
SUBJECT = r"(?iU)^(?:V\s*/\s*v|Về\s+việc)\b"
TITLE = r"(?iU)^(?:THÔNG BÁO|QUYẾT ĐỊNH|QUY ĐỊNH|KẾ HOẠCH|HƯỚNG DẪN|BÁO CÁO|CÔNG VĂN|PHỤ LỤC|DANH SÁCH)\b"
HEADING = r"(?iU)^(?:(?:\d+\.\d+(?:\.\d+)*\.?|\d+[.)])\s+\S|[IVXLCDM]+\.\s+\S|BƯỚC\s+\d+[.:]?\s*\S*)"
ONLY_NUMBER = r"^\d{1,6}$"
DOCUMENT_TYPES = (
    "THÔNG BÁO", "QUYẾT ĐỊNH", "QUY ĐỊNH", "KẾ HOẠCH", "HƯỚNG DẪN", "BÁO CÁO", "CÔNG VĂN", "CHỈ THỊ", "NGHỊ QUYẾT", "TỜ TRÌNH", "BIÊN BẢN", "DANH SÁCH", "PHỤ LỤC", "LỊCH THI", "LỊCH HỌC",
)
URL_OR_EMAIL = r"(?iU)^(?:(?:https?://|www\.)\S+|[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b)"
OPENING = r"""^[(\[{“"']"""

BREAKS = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """The lines that are not blank, without blanks at their ends; null has none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), BREAKS), stripped), lambda x: x != "")


def all_caps(text: Column) -> Column:
    """Whether there are letters, and all of them capitals."""
    return text.rlike(r"\p{L}") & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]")


def kind(text: Column, y0: Column | None = None, page_height: Column | None = None) -> Column:
    """What a block is: metadata, ghi_chu (note), bullet, tieu_de (title), heading or doan_van (paragraph).

    The first line decides, by the first test that holds; footnotes count in the last tenth of a page with
    a height. Blocks of capitals are headings up to 240 characters. Empty and null texts are paragraphs.
    """
    low = F.lit(False) if y0 is None else F.coalesce((page_height > 0) & (y0 >= page_height * 0.90), F.lit(False))

    def of(rows: Column) -> Column:
        first, whole = F.get(rows, F.lit(0)), F.array_join(rows, "\n")
        return (
            F.when(first.isNull(), "doan_van")
            .when(first.rlike(NUMBER) | first.rlike(DATE), "metadata")
            .when(first.rlike(LIST_SUMMARY) | first.rlike(NOTE) | first.startswith("("), "ghi_chu")
            .when(low & first.rlike(FOOTNOTE), "ghi_chu")
            .when(first.rlike(BULLET), "bullet")
            .when(first.rlike(SUBJECT) | first.rlike(TITLE), "tieu_de")
            .when(first.rlike(HEADING) | (all_caps(whole) & (F.length(whole) <= 240)), "heading")
            .otherwise("doan_van")
        )

    return let(lines(text), of)


def goes_on(text: Column) -> Column:
    """Whether a line looks like the continuation of the one before: a small first letter, an opening mark, a URL or an address."""
    t = stripped(F.coalesce(text, F.lit("")))
    letter = F.regexp_extract(t, "[A-Za-zÀ-ỹĐđ]", 0)
    return letter.rlike(r"\p{Ll}") | t.rlike(OPENING) | t.rlike(URL_OR_EMAIL)


def ends_sentence(text: Column, strong: bool = False) -> Column:
    """Whether a line ends with a full stop, a question or an exclamation mark, or unless strong with a colon or semicolon."""
    return F.coalesce(text, F.lit("")).rlike(r"(?U)[.!?]\s*$" if strong else r"(?U)[.!?;:]\s*$")


def split_code(before: Column, after: Column) -> Column:
    """Whether a document's number was cut at its hyphen: one line ends with its digits and first letters, the next begins with the hyphen."""
    number = stripped(F.coalesce(before, F.lit(""))).rlike(r"(?iU)\b\d{1,6}/[A-ZĐ]{1,12}$")
    return number & stripped(F.coalesce(after, F.lit(""))).rlike(r"(?iU)^-\s*[A-ZĐ]{2,12}\b")


def continued(before: Column, after: Column) -> Column:
    """Two lines as one: a cut number without a blank, a hyphen at the end of a cut word away, else a blank between.

    A hyphen stays between digits, after a blank, and before a capital letter.
    """
    a, b = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    small = F.regexp_extract(b, "[A-Za-zÀ-ỹĐđ]", 0).rlike(r"\p{Ll}")
    cut = a.rlike(r"[^ ]-$") & small & ~(a.rlike(r"\p{Nd}-$") & b.rlike(r"^\p{Nd}"))
    code = F.concat(F.rtrim(a), F.regexp_replace(F.ltrim(b), r"^-\s*", "-"))
    return F.when(split_code(a, b), code).when(cut, F.concat(F.left(a, F.length(a) - 1), b)).otherwise(F.trim(F.concat_ws(" ", a, b)))


def comparison_key(text: Column) -> Column:
    """Small letters and digits, all else as single blanks; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\wÀ-ỹĐđ]+", " "))


def titles_overlap(a: Column, b: Column) -> Column:
    """Whether one title holds the other, by their comparison keys; empty ones never."""
    x, y = comparison_key(a), comparison_key(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def document_start(text: Column, block_kind: Column) -> Column:
    """Whether a block begins a document inside a file: a type of document in capitals as title, heading, or in a line
    of capitals; or a title that begins with a subject."""
    k = F.lower(F.trim(F.coalesce(block_kind, F.lit(""))))

    def of(rows: Column) -> Column:
        first = F.coalesce(F.get(rows, F.lit(0)), F.lit(""))
        typed = first.rlike("^(?:" + "|".join(DOCUMENT_TYPES) + ")(?: |$)")
        return F.when(typed, k.isin("tieu_de", "heading", "") | all_caps(first)).otherwise((k == "tieu_de") & first.rlike(SUBJECT))

    return let(lines(text), of)
