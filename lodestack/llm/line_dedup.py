"""Line dedup by a deletion-neighbourhood join over words.

Two lines are near if one word put in, left out or exchanged makes them equal. Then they share a
variant: the line itself or the line without one word. Variants are hashed keys; equal keys meet in a
join; the words themselves are compared; and the earliest line stays. Near lines share the first or the
last half of their words, so a distinct line that shares neither with another gives no variants. All of
it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import let
from lodestack.llm import common

#: Words that a line needs for an edit of one word to leave it 80 % alike; shorter ones must be equal.
MIN_WORDS = 5
#: White space within a line that is not one blank.
GAPS = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"
_LINES = 2**31


def _place(doc: Column, line: Column) -> Column:
    """A line's place in the order of lines as one number: a minimum of it is a hash aggregate, one of pairs is not."""
    return doc.cast("decimal(20,0)") * F.lit(_LINES).cast("decimal(10,0)") + line.cast("decimal(10,0)")


def _placed(place: Column) -> tuple[Column, Column]:
    """The document and the line of a place."""
    line = F.pmod(place, F.lit(_LINES).cast("decimal(10,0)"))
    return ((place - line) / F.lit(_LINES).cast("decimal(10,0)")).cast("long"), line.cast("int")


def _tidy(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), GAPS, " ")


def _tidy_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, s): every line, its words with single blanks between them."""
    at = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(_tidy(F.col(text_col)), "\n")).alias("line_no", "line"))
    return at.where("doc_id is not null").select("doc_id", "line_no", F.trim("line").alias("s"))


def _hashes(s: Column) -> list[Column]:
    return [F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(7), s).alias("h2")]


def _half(s: Column, n: Column, c: Column, side: int) -> Column:
    """Hash of the first or last words that lines of 2c - 1 to 2c + 1 words share one of if an edit separates them."""
    return F.when(n >= MIN_WORDS, F.xxhash64(F.lit(side), c, F.call_function("substring_index", s, F.lit(" "), 1 - c if side else c - 1)))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line with a word as (doc_id, line_no, h1, h2, e0 to e3): the 128-bit hash of its words, and of its halves
    in each class of lengths that it is in (null for short lines). A document without words has one row without hashes.

    Class c has the lines of 2c - 1 to 2c + 1 words: lines as long, or one word longer, share one at least.
    """
    at = _tidy_lines(docs, id_col, text_col).where("s <> '' or line_no = 0")
    n = F.length("s") - F.length(F.replace("s", F.lit(" "), F.lit(""))) + 1
    at = at.select("doc_id", "line_no", F.nullif("s", F.lit("")).alias("s"), n.alias("n"))
    halves = [_half(F.col("s"), F.col("n"), F.shiftright("n", 1), side).alias(f"e{side}") for side in (0, 1)]
    halves += [F.when(F.col("n") % 2 == 1, _half(F.col("s"), F.col("n"), F.shiftright("n", 1) + 1, side)).alias(f"e{2 + side}") for side in (0, 1)]
    h = [F.when(F.col("s").isNotNull(), x).alias(f"h{i + 1}") for i, x in enumerate(_hashes(F.col("s")))]
    return at.select("doc_id", "line_no", *h, *halves)


def variants(lines: DataFrame) -> DataFrame:
    """Of lines (h1, s): the line (pos 0) and the line without its pos-th word, as 128-bit hashes (v1, v2).

    A variant's hash is the exclusive or of its words' hashes by position, so that all variants of a line
    come from running values within the row.
    """

    def word(x: Column, i: Column) -> Column:
        return F.struct(*(F.xxhash64(F.lit(seed), x, i - late).alias(f"p{seed}{late}") for seed in (1, 2) for late in (0, 1)))

    names = [f"p{seed}{late}" for seed in (1, 2) for late in (0, 1)]
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in names))
    at = lines.select("h1", F.transform(F.split("s", " "), word).alias("p"))
    at = at.withColumn("upto", common.scanned(F.col("p"), zero, lambda acc, x: F.struct(*(acc[c].bitwiseXOR(x[c]).alias(c) for c in names))))
    at = at.withColumn("last", F.element_at("upto", -1))

    def without(p: Column, upto: Column) -> Column:
        own = [upto[f"p{s}0"].bitwiseXOR(p[f"p{s}0"]).bitwiseXOR(upto[f"p{s}1"]).bitwiseXOR(F.col(f"last.p{s}1")).alias(f"v{s}") for s in (1, 2)]
        return F.struct(*own)

    whole = F.array(F.struct(F.col("last.p10").alias("v1"), F.col("last.p20").alias("v2")))
    every = F.concat(whole, F.zip_with("p", "upto", without))
    return at.select("h1", F.posexplode(every).alias("pos", "v")).select("h1", "pos", "v.v1", "v.v2")


def near_lines(texts: DataFrame) -> DataFrame:
    """(h1, h2, of): each line (place, h1, h2, s) that has an earlier near one, and the earliest such place.

    Lines without their pos-th word meet at equal pos, or they meet the line that is this variant; every
    such meeting is one edit, so the earliest of a key serves all and no pairs are formed. Each key's
    earliest is verified by itself, before the earliest of all is taken.
    """
    keys = ["v1", "v2"]
    rows = common.written(variants(texts), "variants")
    repeated = common.written(rows.groupBy("v1").count().where("count > 1").select("v1"), "repeated-variants")
    rows = rows.join(repeated.hint("merge"), "v1", "left_semi").join(texts.select("h1", "place"), "h1")
    rows = common.written(rows, "shared-variants")
    first = common.written(rows.groupBy(*keys, "pos").agg(F.min("place").alias("first"), F.count("*").alias("n")), "first-variants")
    shared = first.groupBy(*keys).agg(F.min(F.when(F.col("pos") == 0, F.col("first"))).alias("whole"), F.min(F.when(F.col("pos") > 0, F.col("first"))).alias("cut"))
    same = F.when((F.col("pos") > 0) & (F.col("n") > 1), F.col("first")).alias("same")
    # all lines of one template share a variant: rows of hot ones meet it where they are
    per = common.written(first.select(*keys, "pos", "n", same).join(shared.hint("merge"), keys), "variant-partners")
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = common.hot_join(rows, per, [*keys, "pos"], "n", total)
    partners = F.when(F.col("pos") == 0, F.array("cut")).otherwise(F.array("whole", "same"))
    pairs = common.written(met.select("place", F.explode(partners).alias("of")).where("of < place").distinct(), "line-pairs")
    # of rows that repeat an id two lines may have one place: then each is compared
    both = pairs.join(texts, "place").join(texts.select(F.col("place").alias("of"), F.col("s").alias("v")), "of")
    return both.where(one_edit(F.split("s", " "), F.split("v", " "))).groupBy("h1", "h2").agg(F.min("of").alias("of"))


def one_edit(a: Column, b: Column) -> Column:
    """Whether at most one word put in, left out or exchanged separates two lines of words."""
    differ = F.filter(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: F.when(x["a"].eqNullSafe(x["b"]), None).otherwise(i + 1)), lambda x: x.isNotNull())
    k = F.coalesce(F.get(differ, F.lit(0)), F.lit(1))

    def after(x: Column, at: Column) -> Column:
        return F.slice(x, at, F.greatest(F.size(x) - at + 1, F.lit(0)))

    return (F.size(differ) <= 1) | (after(a, k + 1) == after(b, k)) | (after(a, k) == after(b, k + 1)) | (after(a, k + 1) == after(b, k + 1))


def _likely(docs: DataFrame, once: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(place, h1, h2, s) of the distinct lines that share a half with another."""
    ends = once.select("h1", F.explode(F.array_compact(F.array("e0", "e1", "e2", "e3"))).alias("end"))
    repeated = common.written(ends.groupBy("end").count().where("count > 1").select("end"), "repeated-halves")
    doc, line = _placed(F.col("place"))
    # these sides grow with the table, so they are merged at every size
    likely = common.written(ends.join(repeated.hint("merge"), "end", "left_semi").select("h1").distinct(), "likely-hashes")
    wanted = once.select("h1", "place").join(likely.hint("merge"), "h1", "left_semi").select(doc.alias("doc_id"), F.struct(line.alias("line_no"), "h1").alias("x"))
    wanted = common.written(wanted.groupBy("doc_id").agg(F.collect_set("x").alias("wanted")), "likely-lines")
    # whole texts move, as few rows; each wanted line is taken by its number
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), _tidy(F.col(text_col)).alias("text")).join(wanted.hint("merge"), "doc_id")
    taken = let(F.split("text", "\n"), lambda lines: F.transform("wanted", lambda x: F.struct(x["line_no"].alias("line_no"), x["h1"].alias("wanted"), F.trim(F.get(lines, x["line_no"])).alias("s"))))
    lines = whole.select("doc_id", F.explode(taken).alias("x")).select(_place(F.col("doc_id"), F.col("x.line_no")).alias("place"), *_hashes(F.col("x.s")), "x.s", "x.wanted")
    # rows that repeat an id want each other's lines, too
    return lines.where("s <> '' AND h1 = wanted").select("place", "h1", "h2", "s")


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, near) of every line that goes: an earlier line is equal to it (word by word), or near.

    Earlier is the smaller (doc_id, line_no), lines counted from 0. Lines without words stay. Null texts
    and rows without an id have no lines; of rows that repeat an id the lines count as one document's, and
    lines of one place in them as equal in order.
    """
    return _dropped(docs, common.written(keyed(docs, id_col, text_col), "lines"), id_col, text_col)


def _dropped(docs: DataFrame, every: DataFrame, id_col: str, text_col: str) -> DataFrame:
    every = every.where("h1 is not null")
    once = every.withColumn("place", _place(F.col("doc_id"), F.col("line_no"))).groupBy("h1", "h2").agg(
        F.min("place").alias("place"), F.count("*").alias("copies"), *(F.min(c).alias(c) for c in ("e0", "e1", "e2", "e3")),
    )
    once = common.written(once, "distinct-lines")
    texts = common.written(_likely(docs, once, id_col, text_col), "likely-texts")
    near = common.written(near_lines(texts), "near-lines").select("h1", "h2", F.lit(True).alias("near"))
    doc, line = _placed(F.col("place"))
    marked = once.join(near, ["h1", "h2"], "left").where("copies > 1 or near").select("h1", "h2", "copies", doc.alias("first_doc"), line.alias("first_line"), F.coalesce("near", F.lit(False)).alias("near"))
    marked = common.written(marked, "marked-lines")
    lines = every.select("doc_id", "line_no", "h1", "h2")
    total = once.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    met = common.hot_join(lines, marked, ["h1", "h2"], "copies", total)
    first = (F.col("doc_id") == F.col("first_doc")) & (F.col("line_no") == F.col("first_line"))
    return met.where(~first | F.col("near")).select("doc_id", "line_no", first.alias("near"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each id: doc_id, n_lines (with words), n_dropped, n_near, dropped (line numbers, ascending).

    Null and empty texts have no lines; rows without an id are left out; rows that repeat an id are one row.
    """
    every = common.written(keyed(docs, id_col, text_col), "lines")
    gone = _dropped(docs, every, id_col, text_col).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"), F.count_if("near").alias("n_near"))
    n = every.groupBy("doc_id").agg(F.count("h1").alias("n_lines"))
    none = F.array().cast("array<int>")
    size = F.size(F.coalesce("dropped", none)).cast("long")
    return n.join(gone, "doc_id", "left").select("doc_id", "n_lines", size.alias("n_dropped"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.coalesce("dropped", none).alias("dropped"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (ids unique) without the dropped lines of ``text_col``; rows without an id stay as they are."""
    key, lines = common.fresh(docs, "line_dedup_id", "line_dedup_gone")
    gone = dropped(docs, id_col, text_col).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(lines))
    out = docs.join(gone, F.col(id_col).cast("long") == F.col(key), "left")
    left = let(F.split(text_col, "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(lines)), lambda i: F.get(x, i)), "\n"))
    return out.withColumn(text_col, F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(left)).drop(key, lines)
