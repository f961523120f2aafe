"""Text expressions, Column to Column: folding, spacing, dictionary rewriting and extraction.

Java's ``\\w``, ``\\b`` and ``(?i)`` know ASCII only; patterns over unfolded text start with ``(?U)`` or
``(?iu)``. Patterns over folded text need neither.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_tables() -> tuple[str, str]:
    """Letters that decompose to an ASCII letter and marks, with that letter; combining marks at the end, to be dropped."""
    source, target = ["đ", "Đ"], ["d", "d"]
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            source.append(chr(cp))
            target.append(base[0].lower())
    marks = [chr(cp) for cp in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target)


_FROM, _TO = _fold_tables()


def fold(text: Column) -> Column:
    """Lower case without diacritics; null stays null."""
    return F.translate(F.lower(text), _FROM, _TO)


def quick_fold(text: Column) -> Column:
    """``fold`` that translates only texts with a letter beyond ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), fold(text)).otherwise(F.lower(text))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spaced(text: Column) -> Column:
    """White space as single blanks, none at the ends; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def folded(text: Column) -> Column:
    return spaced(fold(text))


def present(text: Column) -> Column:
    """The trimmed text, null if that is empty."""
    return F.nullif(F.trim(text), F.lit(""))


def contains_any(text: Column, phrases) -> Column:
    """Whether one of many fixed phrases occurs: one pass of one pattern."""
    return F.coalesce(text.rlike("|".join(re.escape(p) for p in phrases)), F.lit(False))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


def punctuated(text: Column) -> Column:
    """No blank before , . ; : ! ? and one after, except in texts with a URL."""
    tidy = F.regexp_replace(F.regexp_replace(text, r"\s+([,.;:!?])", "$1"), r"([,;!?])(?=[^\s,.;:!?)])", "$1 ")
    return F.when(text.rlike(r"(?i)https?://|www\."), text).otherwise(tidy)


def slug(text: Column) -> Column:
    """ASCII letters and digits alone, case kept; đ and Đ as d and D."""
    plain = F.translate(text, *_case_tables())
    return F.regexp_replace(plain, "[^A-Za-z0-9]", "")


def _case_tables() -> tuple[str, str]:
    pairs = [("đ", "d"), ("Đ", "D")]
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(cp))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            pairs.append((chr(cp), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def roman(number: Column) -> Column:
    """Roman numerals of 1 to 15, else the digits as text."""
    names = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV".split()
    return F.coalesce(F.get(F.array(*map(F.lit, names)), number.cast("int") - 1), number.cast("string"))


# --- dictionary rewriting ---------------------------------------------------------------------------

# The query language's abbreviations, spellings and protected forms.
ABBREVIATIONS = {
    "khht": "kế hoạch học tập", "dkhp": "đăng ký học phần", "đkhp": "đăng ký học phần", "ctđt": "chương trình đào tạo", "ctdt": "chương trình đào tạo",
    "khmt": "khoa học máy tính", "cntt": "công nghệ thông tin", "lvtn": "luận văn tốt nghiệp", "mssv": "mã số sinh viên",
    "hk1": "học kỳ 1", "hk2": "học kỳ 2", "hk3": "học kỳ 3", "hk": "học kỳ", "hp": "học phần", "sv": "sinh viên", "tc": "tín chỉ",
}
KEPT_ABBREVIATIONS = {"khht", "dkhp", "đkhp", "ctđt", "ctdt", "khmt", "cntt", "lvtn", "mssv"}
SYNONYMS = {"đăng kí": "đăng ký", "học kì": "học kỳ", "môn học": "học phần", "mã sv": "mã sinh viên", "mã số sv": "mã số sinh viên", "khoá": "khóa"}
TYPOS = {"đăn ký": "đăng ký", "đăng ky": "đăng ký", "học ki": "học kỳ", "sinh vien": "sinh viên", "hoc phan": "học phần"}
PROTECTED = [
    r"\b\d{4}-\d{1,2}-\d{1,2}\b", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b\d{4}\s*[-–—/]\s*\d{4}\b", r"\b\d{7}_\d{2}_(?:STD|CLC)\b",
    r"\b[A-Z]{2,4}\d{3}[A-Z0-9]*\b", r"\b[A-Z]\d{7}\b", r"\bK\d{2}\b", r"\b\d{1,4}/[A-ZĐ][A-Z0-9Đ._-]*(?:-[A-ZĐ0-9._-]+)*\b",
]


def rewritten(text: Column, rules: dict[str, str], kept: frozenset | set = frozenset()) -> Column:
    """Whole words and phrases replaced, longest first. Those in ``kept`` stay behind in brackets, in upper
    case, and are left alone where brackets are already there."""
    for key in sorted(rules, key=len, reverse=True):
        text = F.regexp_replace(text, *rule(key, rules[key], key in kept))
    return text


def rule(key: str, target: str, kept: bool = False) -> tuple[str, str]:
    """The pattern of a whole word or phrase and what stands for it; one that is kept stays behind in brackets."""
    if kept:
        return rf"(?iU)(?<!\()(?<!\w){re.escape(key)}(?!\w)(?!\s*\()", f"{target} ({key.upper()})"
    return rf"(?iU)(?<!\w){re.escape(key)}(?!\w)", target


def normalised_query(text: Column) -> Column:
    """A query with abbreviations, synonyms and typos rewritten; dates, codes and numbers of documents stay as they are.

    The text is cut at its protected values; the parts between are rewritten and the values put back. A
    mark stands at each cut, so that words which touch a value are no whole words.
    """
    either = f"(?iU)(?:{'|'.join(PROTECTED)})"
    clean = spaced(text)
    mark = "Z9"  # stands for the value: word characters
    parts = F.split(clean, either)
    fenced = F.transform(parts, lambda p, i: F.concat(F.when(i > 0, mark).otherwise(""), p, F.when(i < F.size(parts) - 1, mark).otherwise("")))

    def rules(part: Column) -> Column:
        out = part
        for table, kept in ((ABBREVIATIONS, KEPT_ABBREVIATIONS), (SYNONYMS, frozenset()), (TYPOS, frozenset())):
            out = rewritten(out, table, kept)
        return out

    done = F.transform(fenced, rules)
    bare = F.transform(done, lambda p, i: F.substring(p, F.when(i > 0, 3).otherwise(1), F.length(p) - F.when(i > 0, 2).otherwise(0) - F.when(i < F.size(parts) - 1, 2).otherwise(0)))
    values = F.regexp_extract_all(clean, F.lit(either), F.lit(0))
    return spaced(F.array_join(F.flatten(F.zip_with(bare, values, lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), ""))


def same_identifiers(original: Column, candidate: Column, most: int = 500) -> Column:
    """Whether a rewriting is safe: not empty nor too long, the same numbers in order, the same codes."""

    def codes(t: Column) -> Column:
        found = [
            F.regexp_extract_all(F.upper(t), F.lit(p), F.lit(0))
            for p in (r"(?<![A-Z0-9])[A-Z]{2,4}\d{3}[A-Z]?(?![A-Z0-9])", r"(?<![A-Z0-9])[A-Z]\d{7}(?![A-Z0-9])", r"(?U)\bK\s*\d{2}\b", r"(?U)\b\d{1,6}\s*/\s*[A-ZĐ][A-ZĐ-]{1,20}\b")
        ]
        return F.array_sort(F.array_distinct(F.transform(F.concat(*found), lambda x: F.regexp_replace(x, r"\s+", ""))))

    numbers = lambda t: F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0))
    tidy = spaced(candidate)
    return (tidy != "") & (F.length(tidy) <= most) & (numbers(original) == numbers(tidy)) & (codes(original) == codes(tidy))


# --- entities and time --------------------------------------------------------------------------------


def course_code(text: Column) -> Column:
    return first_group(F.upper(text), r"(?<![A-Z0-9])([A-Z]{2,4}\d{3}[A-Z]?)(?![A-Z0-9])")


def student_code(text: Column) -> Column:
    return first_group(F.upper(text), r"(?<![A-Z0-9])([A-Z]\d{7})(?![A-Z0-9])")


def cohort(text: Column) -> Column:
    return F.concat(F.lit("K"), first_group(fold(text), r"\b(?:khoa|k)\s*(\d{2})\b"))


def time_scope(text: Column) -> Column:
    """struct(school_start, school_end, year, semester) of a question: a pair of years, else a single one."""
    plain = fold(text)
    pair = r"(?<!\d)(20\d{2})\D+(20\d{2})(?!\d)"
    start, end = (first_group(plain, pair, g).cast("int") for g in (1, 2))
    year = F.when(start.isNull(), first_group(plain, r"(?<!\d)(20\d{2})(?!\d)").cast("int"))
    semester = first_group(plain, r"\b(?:hoc\s*ky|hk)\s*([123])\b").cast("int")
    return F.struct(start.alias("school_start"), end.alias("school_end"), year.alias("year"), semester.alias("semester"))


def file_period(name: Column, title: Column) -> Column:
    """struct(school_start, school_end, semester) of a file name and title; 24_25 means 2024 and 2025."""
    text = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(title, F.lit("")))
    full, short = r"(?<!\d)(20\d{2})\D+(20\d{2})(?!\d)", r"(?<!\d)(\d{2})[_-](\d{2})(?!\d)"
    start, end = (F.coalesce(first_group(text, full, g).cast("int"), first_group(text, short, g).cast("int") + 2000) for g in (1, 2))
    semester = F.coalesce(first_group(text, r"(?i)(?:^|[^a-z0-9])hk\s*([123])(?:[^0-9]|$)"), first_group(text, r"(?iu)học\s*kỳ\s*([123])"))
    return F.struct(start.alias("school_start"), end.alias("school_end"), semester.cast("int").alias("semester"))


def date_parts(text: Column) -> Column:
    """struct(y, m, d) of a date of any precision; a part that is absent or out of range is 0."""
    n = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))

    def within(i: int, low: int, high: int) -> Column:
        return F.when(F.get(n, F.lit(i)).between(low, high), F.get(n, F.lit(i))).otherwise(0)

    return F.struct(within(0, 1000, 9999).alias("y"), within(1, 1, 12).alias("m"), within(2, 1, 31).alias("d"))


def issue_date(text: Column) -> Column:
    """The date of an official issue line as YYYY, YYYY-MM or YYYY-MM-DD; null outside such a line or for no real date.

    Each of three patterns is tried once, the next one only where the one before finds nothing.
    """
    numbers = lambda line, pattern: F.regexp_extract_all(F.regexp_extract(line, pattern, 0), F.lit(r"\d+"), F.lit(0))
    part = lambda n, i: F.lpad(F.get(n, F.lit(i)), 2, "0")

    def whole(n: Column) -> Column:
        date = F.concat_ws("-", F.get(n, F.lit(2)), part(n, 1), part(n, 0))
        return F.when(F.try_to_date(date, "yyyy-MM-dd").isNotNull(), date)

    def month(n: Column) -> Column:
        return F.when(F.get(n, F.lit(0)).cast("int").between(1, 12), F.concat_ws("-", F.get(n, F.lit(1)), part(n, 0)))

    def date(line: Column) -> Column:
        year = first_group(line, r"(?iU)\bngày(?:\s+\d{1,2})?\s+tháng\s*năm\s+(\d{4})\b")
        months = let(numbers(line, r"(?iU)\btháng\s+(\d{1,2})\s*năm\s+(\d{4})\b"), lambda n: F.when(F.size(n) == 2, month(n)).otherwise(year))
        return let(numbers(line, r"(?iU)\bngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s*năm\s+(\d{4})\b"), lambda n: F.when(F.size(n) == 3, whole(n)).otherwise(months))

    return let(spaced(text), lambda line: F.when(line.rlike(r"(?iU)\bCần\s+Thơ\s*,?\s*ngày\b"), date(line)))


def document_code(text: Column) -> Column:
    """Number and symbol of an official document, joined by a slash."""
    # fixed value
    pattern = r"(?iU)\bSố\s*:?\s*(\d{1,6})\s*/\s*([A-ZÀ-ỸĐ0-9][A-ZÀ-ỸĐ0-9&.\-–—/]*)"
    number, symbol = first_group(text, pattern, 1), first_group(text, pattern, 2)
    return F.when(number.isNotNull(), F.concat_ws("/", number, symbol))


# --- structure ----------------------------------------------------------------------------------------


def section(line: Column) -> Column:
    """struct(symbol, level) of a heading in one of five grammars; null for other lines."""
    # fixed values: the grammars of numbers
    tries = [
        (r"(?s)^\s*(\d+(?:\.\d+)+)\.?\s+.+$", lambda s: s, True), (r"(?s)^\s*(\d+)\.\s+.+$", lambda s: s, False), (r"(?is)^\s*([IVXLCDM]+)\.\s+.+$", F.upper, False),
        (r"(?isU)^\s*BƯỚC\s+(\d+)\s*[.：:\-–—]?\s*.*$", lambda s: F.concat(F.lit("Bước "), s), False), (r"(?isU)^\s*ĐIỀU\s+(\d+[A-ZĐ]?)\s*[.)：:]?\s*.*$", lambda s: F.concat(F.lit("Điều "), s), False),
    ]
    out = None
    for pattern, name, nested in tries:
        number = first_group(line, pattern)
        level = F.size(F.split(number, r"\.")) if nested else F.lit(1)
        found = F.struct(name(number).alias("symbol"), level.alias("level"))
        out = F.when(number.isNotNull(), found) if out is None else out.when(number.isNotNull(), found)
    return out


def structural_references(question: Column) -> Column:
    """References to chapters, articles, clauses and points, as array of struct(kind, chapter, article, clause, point).

    A point suppresses its clause, and any part of an article the article alone. Points d and đ are two.
    """
    q = F.translate(F.lower(question), _FROM.replace("đ", "").replace("Đ", ""), _TO[2:])
    empty = F.lit(None).cast("string")

    def refs(kind: str, pattern: str, **groups: int) -> Column:
        n = len(F_GROUPS)
        found = F.regexp_extract_all(q, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), *((F.regexp_extract(m, pattern, groups[g]) if g in groups else empty).alias(g) for g in F_GROUPS[:n])))

    chapters = F.transform(refs("chapter", r"(?U)\bchuong\s+([ivxlcdm]+|\d+)\b", chapter=1), lambda r: r.withField("chapter", F.when(r["chapter"].rlike(r"^\d+$"), roman(r["chapter"].try_cast("int"))).otherwise(F.upper(r["chapter"]))))
    points = refs("point", r"(?U)\b[dđ]ieu\s+(\d+).*?\bkhoan\s+(\d+).*?\b[dđ]iem\s+([a-zđ])\b", article=1, clause=2, point=3)
    clauses = F.filter(refs("clause", r"(?U)\b[dđ]ieu\s+(\d+).*?\bkhoan\s+(\d+)", article=1, clause=2), lambda r: ~F.exists(points, lambda p: (p["article"] == r["article"]) & (p["clause"] == r["clause"])))
    parts = F.concat(points, clauses)
    articles = F.filter(refs("article", r"(?U)\b[dđ]ieu\s+(\d+)", article=1), lambda r: ~F.exists(parts, lambda p: p["article"] == r["article"]))
    return F.concat(chapters, parts, F.array_distinct(articles))


F_GROUPS = ("chapter", "article", "clause", "point")


def cross_references(text: Column) -> Column:
    """References within regulations to other places, as array of struct(article, clause, point); empty parts are ''."""

    def refs(pattern: str, article: int, clause: int, point: int) -> Column:
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
        return F.transform(found, lambda m: F.struct(*(F.regexp_extract(m, pattern, g).alias(n) for n, g in (("article", article), ("clause", clause), ("point", point)))))

    return F.concat(refs(r"(?iu)Xem\s+Điều\s+(\d+)(?:\s+Khoản\s+(\d+))?(?:\s+Điểm\s+([a-z]))?", 1, 2, 3), refs(r"(?iu)điểm\s+([a-z])\s+khoản\s+(\d+)\s+Điều\s+(\d+)", 3, 2, 1))


# --- classifiers ----------------------------------------------------------------------------------------

# Phrases that give a question's notice type.
NOTICE_SIGNALS = {
    "xoa_lop_hoc_phan": ("xoa lop hoc phan", "lop hoc phan bi xoa", "huy lop hoc phan", "lop hoc phan bi huy", "si so khong du", "khong du mo lop"),
    "xet_chuyen_nganh": ("chuyen nganh", "doi nganh", "thay doi nganh hoc"),
    "diem_ren_luyen": ("diem ren luyen", "danh gia diem ren luyen", "drl"),
    "dang_ky_hoc_phan": ("dang ky hoc phan", "ke hoach dang ky hoc phan", "ke hoach giang day", "ke hoach hoc tap"),
    "lich_nghi": ("lich nghi", "nghi le", "nghi tet", "tet am lich", "quoc khanh", "gio to hung vuong", "quoc te lao dong"),
}
# Phrases that ask for a list.
LIST_SIGNALS = (
    "danh sach", "nhung ai", "ai duoc", "ai bi", "sinh vien nao", "nhung sinh vien nao", "cac sinh vien nao", "hoc phan nao", "nhung hoc phan nao",
    "cac hoc phan nao", "lop nao", "nhung lop nao", "cac lop nao", "cac truong hop nao",
)


def question_types(question: Column) -> Column:
    """All notice types whose phrases a question has."""
    q = folded(question)
    return F.array_compact(F.array(*(F.when(contains_any(q, phrases), F.lit(kind)) for kind, phrases in NOTICE_SIGNALS.items())))


def question_type(question: Column) -> Column:
    """The one notice type of a question; null if there is none or more than one."""
    found = question_types(question)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def title_type(title: Column) -> Column:
    """The notice type of a document's title, by the first rule that holds."""
    t = fold(title)
    return (
        F.when(t.rlike(r"\bnganh\b") | (t.contains("chuyen") & t.contains("chuong trinh")), "xet_chuyen_nganh").when(t.contains("diem ren luyen"), "diem_ren_luyen")
        .when(t.contains("dang ky hoc phan"), "dang_ky_hoc_phan").when(t.contains("xoa") & t.contains("lop hoc phan"), "xoa_lop_hoc_phan")
        .when(t.rlike("tet|gio to|quoc khanh"), "lich_nghi").otherwise("thong_bao_khac")
    )


def asks_list(question: Column) -> Column:
    return contains_any(folded(question), LIST_SIGNALS)


# The rules that route a question, in order: a domain, and conditions that must all hold. A condition is a pattern, or
# phrases of which one occurs.
COURSE_IN_QUESTION = r"(?<![a-z0-9])[a-z]{2,4}\d{3}[a-z]?(?![a-z0-9])"
PROGRAM_IN_QUESTION = ("nganh ", "chuong trinh dao tao", "ctdt")
TIME_IN_QUESTION = r"\b(?:khi nao|ngay nao|thoi gian|han|dot|bat dau|ket thuc|lich)\b"
ROUTES = (
    ("SOCIAL", r"^$"),
    ("SOCIAL", r"^(?:(?:xin )?(?:chao|hello|hi)(?: ban| chatbot| tro ly)?|(?:cam on|thanks|thank you)(?: ban)?|(?:ban la ai|ban co the lam gi|tro ly nay lam gi))[.!? ]*$"),
    ("QCHV", r"\b(?:chuong|dieu|khoan|diem)\s+(?:[ivxlcdm]+|\d+|[a-z])\b"),
    ("QCHV", r"^quy dinh |theo quy dinh"),
    ("QCHV", r"\b(?:ke hoach hoc tap chuan toan khoa|hoc phan tien quyet|hoc phan song hanh|hoc ky)\b.*\bla gi\b"),
    ("THONG_BAO", COURSE_IN_QUESTION, ("bi xoa", "xoa lop", "mo lop", "lich hoc", "dang ky khi nao")),
    ("CTDT", COURSE_IN_QUESTION, ("bao nhieu tin chi", "tien quyet", "song hanh", "hoc phan truoc", "thuoc khoi", "hoc ky nao", "ten hoc phan")),
    ("CTDT", PROGRAM_IN_QUESTION, ("bao nhieu tin chi", "gom nhung hoc phan", "gom cac hoc phan", "hoc nhung mon", "hoc mon gi", "chuan dau ra", "cau truc chuong trinh", "ke hoach hoc tap chuan")),
    ("THONG_BAO", TIME_IN_QUESTION, ("dang ky hoc phan", "dang ky khht", "dang ky ke hoach hoc tap", "dieu chinh khht", "dieu chinh ke hoach hoc tap", "hoc ky", "nghi", "xoa lop", "chuyen nganh", "dong hoc phi")),
    ("THONG_BAO", ("danh sach",), ("sinh vien", "chuyen nganh", "xoa lop", "lop hoc phan")),
)


def domain(question: Column) -> Column:
    """The domain of a question, by the first rule of ``ROUTES`` that holds; null if none does, for a model to decide."""

    def of(q: Column) -> Column:
        holds = lambda condition: q.rlike(condition) if isinstance(condition, str) else contains_any(q, condition)
        return F.coalesce(*(F.when(reduce(Column.__and__, map(holds, conditions)), name) for name, *conditions in ROUTES))

    return let(folded(question), of)


# Words that name a regulation, and those that ask for a relation of courses.
REGULATIONS = {
    "quydinhdaotaotructuyen": ("trực tuyến", "online", "e-learning", "đào tạo trực tuyến"),
    "QCDTVHVL": ("vừa học vừa làm", "vhvl", "tại chức", "hệ vừa học"),
    "QCDTTuXa": ("từ xa", "đào tạo từ xa", "hệ từ xa"),
}
COURSE_RELATIONS = {"YEU_CAU_TIEN_QUYET": "tiên quyết", "CO_THE_SONG_HANH": "song hành"}
#: Glyphs of symbol fonts, as text.
GLYPHS = {"\uf0e0": " đến ", "\uf0b7": "-"}


def regulation(question: Column) -> Column:
    """The regulation that a question names, the first of the list; null if it names none."""
    low = F.lower(question)
    return F.coalesce(*(F.when(contains_any(low, words), F.lit(key)) for key, words in REGULATIONS.items()))


def course_relations(hints: Column, question: Column) -> Column:
    """Relations to follow from a course: the known ones among the hints, each once, else those that the question's words ask for."""
    tidy = F.transform(F.coalesce(hints, F.array().cast("array<string>")), lambda h: F.upper(F.trim(F.coalesce(h, F.lit("")))))
    given = F.array_distinct(F.filter(tidy, lambda h: h.isin(*COURSE_RELATIONS)))
    low = F.lower(F.coalesce(question, F.lit("")))
    asked = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), F.lit(r)) for r, w in COURSE_RELATIONS.items())))
    return F.when(F.size(given) > 0, given).otherwise(asked)


def cohort_of_year(year: Column) -> Column:
    """Students who begin in a year are the cohort of that year less 1974."""
    return (year - 1974).cast("int")


def compatible(text: Column) -> Column:
    """Unicode's compatibility form (NFKC), Arrow batch by batch: the JVM's functions have none."""

    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFKC")

    return nfkc(text)


def repaired(text: Column) -> Column:
    """Text of pages: compatible letters, plain spaces, glyphs as text, even ranges and times, no blank ends of lines,
    one empty line at most between others. Null counts as empty."""
    t = F.translate(compatible(F.coalesce(text, F.lit(""))), "\u00a0\u2007\u202f\ufeff", "   ")
    for glyph, plain in GLYPHS.items():
        t = F.replace(t, F.lit(glyph), F.lit(plain))
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"(?iU)(?<=\d)\s*đến\s*(?=\d)", " đến ")
    t = F.regexp_replace(t, r"(?U)\b([01]?\d|2[0-3])\s*:\s*([0-5]\d)\b", "$1:$2")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")
