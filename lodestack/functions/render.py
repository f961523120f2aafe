"""Rendering and reading of properties, numbers and free-form answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Properties in the order in which they are shown; others follow by name.
PREFERRED = (
    "ma_hoc_phan", "ten_hoc_phan", "so_tin_chi", "ma_nganh", "ten_nganh_vi", "ten_khoa", "khoa", "he", "tong_tin_chi", "ten_khoi", "tieu_de", "ten", "so", "ky_hieu",
    "path", "noi_dung", "text_embed", "noi_dung_dong", "gia_tri",
)
#: Properties that hold vectors are never shown.
VECTORS = ("embedding", "embeddings", "vector")


def without_vectors(props: Column) -> Column:
    return F.map_filter(props, lambda k, v: ~F.lower(k).isin(*VECTORS) & ~F.lower(k).startswith("embedding"))


def useful_properties(props: Column, most: int = 12) -> Column:
    """Lines of key: value, preferred keys first, blank values left out, at most so many."""
    order = F.array(*map(F.lit, PREFERRED))
    place = lambda k: F.when(F.array_contains(order, k), F.array_position(order, k)).otherwise(len(PREFERRED) + 1)
    good = F.filter(F.map_entries(without_vectors(props)), lambda e: ~F.coalesce(F.trim(e["value"]), F.lit("")).isin("", "[]"))
    ranked = F.array_sort(F.transform(good, lambda e: F.struct(place(e["key"]).alias("p"), e["key"].alias("k"), F.trim(e["value"]).alias("v"))))
    return F.transform(F.slice(ranked, F.lit(1), F.lit(most)), lambda e: F.concat_ws(": ", e["k"], e["v"]))


def display_name(props: Column, fallback: Column, keys: tuple[str, ...] = ("ten_hoc_phan", "ten_nganh_vi", "ten_khoi", "ten", "tieu_de", "name")) -> Column:
    """The first property of these that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(props[k]), F.lit("")) for k in keys), fallback)


def truncated(text: Column, most: int, mark: str = "...") -> Column:
    """A text of at most so many characters, with a mark where it was cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - len(mark))), F.lit(mark)))


def short(text: Column, most: int = 1000) -> Column:
    """A text on one line, cut after so many characters with an ellipsis."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most)), F.lit("…")))


def row_line(headers: Column, cells: Column, text: Column) -> Column:
    """A row on one line: header: value where both have content, else the values, else its text."""
    pairs = F.zip_with(headers, F.slice(cells, F.lit(1), F.size(headers)), lambda h, v: F.when((F.trim(h) != "") & (F.trim(v) != ""), F.concat_ws(": ", F.trim(h), F.trim(v))))
    named = F.array_join(F.array_compact(pairs), " | ")
    plain = F.array_join(F.transform(cells, lambda v: F.trim(F.coalesce(v, F.lit("")))), " | ")
    return F.coalesce(F.nullif(named, F.lit("")), F.when(plain.rlike(r"[^ |]"), plain), short(text))


def section_label(symbol: Column) -> Column:
    """How a section is named in a context."""
    s = F.trim(F.coalesce(symbol, F.lit("")))
    return F.when(s != "", F.concat_ws(" ", F.lit("Mục"), s)).otherwise("Mục không ký hiệu")


def salvaged_json(answer: Column, schema: str) -> Column:
    """The object within an answer: what stands between its first and last brace, fences aside; null if that is none."""
    return F.from_json(F.nullif(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\{.*\})", 1), F.lit("")), schema)


def number(text: Column, default: float = 0.0) -> Column:
    """A number with a decimal point or comma, else the default."""
    return F.coalesce(F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double"), F.lit(default))


def fixed(value: Column, places: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value, halves to even, as C and Python do; Java's %f rounds its decimal text."""
    return F.coalesce(F.call_function("format_number", value, F.lit("0." + "0" * places)), F.lit("null"))


def percent(part: Column, whole: Column) -> Column:
    """n/N = p%, and N/A of nothing."""
    return F.when(whole > 0, F.format_string("%d/%d = %s%%", part.cast("long"), whole.cast("long"), fixed(100.0 * part / whole, 1))).otherwise("N/A")


def clamped(value: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("int"), F.lit(default))))


def markdown_headers(line: Column) -> Column:
    """Numbered bold lines as headers of their depth, and emphasis removed elsewhere."""
    plain = F.regexp_replace(line, r"\*\*|__", "")
    numbered = F.regexp_extract(plain, r"^\s*(\d+(?:\.\d+)*)\.?\s+\S", 1)
    bold = line.rlike(r"^\s*(?:\*\*|__)\s*\d")
    return F.when(line.rlike(r"^\s*#"), plain).when(bold & (numbered != ""), F.concat(F.repeat(F.lit("#"), F.size(F.split(numbered, r"\.")) + 1), F.lit(" "), F.trim(plain))).otherwise(plain)


def bullets(text: Column) -> Column:
    """Items of a list: lines that begin with a bullet, with the lines that go on from them."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^\s*[-+•*–]\s+", "\u0001")
    items = F.slice(F.split(marked, "\u0001"), F.lit(2), F.greatest(F.size(F.split(marked, "\u0001")) - 1, F.lit(0)))
    return F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def vector_lines(target: Column, index: Column, hits: Column) -> Column:
    """The hits (score, labels, props) of a target in order as text: the target with its index, then a line for each; '' without hits.
    Properties that hold vectors are left out."""
    head = F.concat(F.lit("- "), target, F.when(F.coalesce(index, F.lit("")) != "", F.concat(F.lit(" ["), index, F.lit("]"))).otherwise(""))
    one = lambda h, i: F.concat(F.format_string("  %d. score=%s labels=", i + 1, fixed(h["score"], 6)), F.to_json(h["labels"]), F.lit(" node="), F.to_json(without_vectors(h["props"])))
    return F.when(F.size(hits) > 0, F.concat_ws("\n", head, F.array_join(F.transform(hits, one), "\n"))).otherwise("")
