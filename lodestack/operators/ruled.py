"""Tables of courses from ruled pages: rows and columns from the coordinates of lines, then words into cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import let

# Names of columns that make a header, what tells of a block of knowledge, and how its row is marked.
HEADER_NAMES = ("Mã số", "Tên học phần")
BLOCK = "Khối kiến thức"
BLOCK_MARK = "BLOCK_HEADER:"
#: Lines nearer than this are one.
SNAP = 3.0


def _fold(values: Column, kind: str, starts, first, merged) -> Column:
    """An array's neighbours made one, as an array of ``kind``: an element starts a group of its own or is merged into the last."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.when((F.size(acc) == 0) | starts(last, x), F.concat(acc, F.array(first(x)))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged(last, x))))

    return F.aggregate(values, F.array().cast(f"array<{kind}>"), step)


def _islands(points: Column, snap: float) -> Column:
    """Groups (low, high, mean) of ascending ``points`` with gaps of no more than ``snap``."""
    one, count = lambda x: F.struct(x.alias("low"), x.alias("high"), x.alias("s"), F.lit(1).alias("n")), lambda g, x: F.struct(g["low"].alias("low"), x.alias("high"), (g["s"] + x).alias("s"), (g["n"] + 1).alias("n"))
    groups = _fold(points, "struct<low:double, high:double, s:double, n:int>", lambda g, x: x - g["high"] > snap, one, count)
    return F.transform(groups, lambda g: F.struct(g["low"].alias("low"), g["high"].alias("high"), (g["s"] / g["n"]).alias("mean")))


def grid(lines: DataFrame, by: list[str], snap: float = SNAP) -> DataFrame:
    """(by, table_no, rows, last_c, right) of the ruled tables of ``lines`` (by, x0, y0, x1, y1). Vertical lines whose heights touch are of
    one table. rows are (r, top, bottom, edges) between horizontal lines, and edges (c, x) the left sides of the cells that a row really
    has: where it has no line at a column's side the cells are one.

    A page's lines are gathered, as a page has few; what follows needs neither shuffles nor sorts of the lines of all pages."""
    wide, high = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    up = F.when((wide <= snap) & (high > snap), F.struct(F.least("y0", "y1").alias("y0"), F.greatest("y0", "y1").alias("y1"), ((F.col("x0") + F.col("x1")) / 2).cast("double").alias("x")))
    flat = F.when((high <= snap) & (wide > snap), ((F.col("y0") + F.col("y1")) / 2).cast("double"))
    at = lines.where(reduce(Column.__and__, (F.col(b).isNotNull() for b in by))).select(*by, up.alias("up"), flat.alias("flat")).groupBy(*by).agg(F.sort_array(F.collect_list("up")).alias("up"), F.sort_array(F.collect_list("flat")).alias("flat"))
    kept = lambda g, u: F.struct(g["low"].alias("low"), F.greatest(g["high"], u["y1"]).alias("high"))
    tables = _fold(F.col("up"), "struct<low:double, high:double>", lambda g, u: u["y0"] > g["high"] + snap, lambda u: F.struct(u["y0"].alias("low"), u["y1"].alias("high")), kept)
    at = at.select(*by, "up", "flat", F.posexplode(tables).alias("_t", "t"))
    low, high = F.col("t.low"), F.col("t.high")

    # what a lambda uses often is bound by let: a column of a select before would be worked out at each use
    def found(up: Column, sides: Column) -> Column:
        own = lambda g, c: F.struct(c.alias("c"), g["mean"].alias("x"), F.filter(up, lambda u: u["x"].between(g["low"], g["high"])).alias("up"))
        return let(F.transform(_islands(F.sort_array(F.transform(up, lambda u: u["x"])), snap), own), lambda columns: rows(sides, columns))

    def rows(sides: Column, columns: Column) -> Column:
        def row(side: Column, r: Column) -> Column:
            below = F.get(sides, r + 1)["mean"]
            there = let((side["mean"] + below) / 2, lambda middle: F.filter(columns, lambda g: F.exists(g["up"], lambda u: middle.between(u["y0"], u["y1"]))))
            return F.struct(r.alias("r"), side["mean"].alias("top"), below.alias("bottom"), F.transform(there, lambda g: F.struct(g["c"].alias("c"), g["x"].alias("x"))).alias("edges"))

        return F.transform(F.slice(sides, F.lit(1), F.greatest(F.size(sides) - 1, F.lit(0))), row)

    of = let(F.filter("up", lambda u: u["y0"].between(low, high)), lambda up: let(_islands(F.filter("flat", lambda y: y.between(low - snap, high + snap)), snap), lambda sides: found(up, sides)))
    last = lambda r: F.array_max(F.flatten(F.transform(r, lambda x: x["edges"])))
    at = at.select(*by, (F.col("_t") + 1).cast("long").alias("table_no"), F.inline(F.array(let(of, lambda r: F.struct(r.alias("rows"), last(r).alias("last"))))).alias("rows", "last"))
    return at.where("last is not null").select(*by, "table_no", "rows", (F.col("last.c") - 1).alias("last_c"), F.col("last.x").alias("right"))


def cells(words: DataFrame, lines: DataFrame, by: list[str], snap: float = SNAP) -> DataFrame:
    """(by, table_no, r, cells): the rows of ruled tables; words (by, word_no, x0, y0, x1, y1, text) belong to the cell that has their
    centre. A cell's words are in reading order, one line; cells without words, and those that a wider one covers, are ''.

    Lines and words are shuffled by their page once, or not at all where they are dealt by it; pages meet as one row each."""
    word = F.struct("y0", "x0", "word_no", F.trim("text").alias("text"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    said = words.where(F.trim("text") != "").select(*by, word.alias("w")).groupBy(*by).agg(F.collect_list("w").alias("words"))
    at = grid(lines, by, snap).join(said.hint("merge"), by, "left")
    key = lambda w: F.struct(w["y0"], w["x0"], w["word_no"], w["text"])

    def placed(row: Column, words: Column) -> Column:
        """A row's words in reading order, each with its column."""
        inside = F.filter(words, lambda w: (w["cy"] >= row["top"]) & (w["cy"] < row["bottom"]))
        left = lambda w: F.try_element_at(F.filter(row["edges"], lambda e: e["x"] <= w["cx"]), F.lit(-1))["c"]
        of = F.transform(inside, lambda w: F.struct(w["y0"].alias("y0"), w["x0"].alias("x0"), w["word_no"].alias("word_no"), w["text"].alias("text"), left(w).alias("c")))
        return F.sort_array(F.filter(of, lambda w: w["c"].isNotNull()))

    within = F.filter(F.coalesce("words", F.array()), lambda w: w["cx"] < F.col("right"))
    rows = let(within, lambda words: F.transform("rows", lambda row: F.struct(row["r"].alias("r"), placed(row, words).alias("words"))))
    at = at.select(*by, "table_no", "last_c", F.inline(rows).alias("r", "words"))
    # a word that comes again counts once, in its last column
    once = F.filter("words", lambda w, i: ~key(w).eqNullSafe(key(F.get("words", i + 1))))
    join = lambda words, c: F.regexp_replace(F.array_join(F.transform(F.filter(words, lambda w: w["c"] == c), lambda w: w["text"]), " "), r"\s+", " ")
    filled = let(once, lambda words: F.transform(F.sequence(F.lit(0), F.greatest("last_c", F.lit(0))), lambda c: join(words, c)))
    return at.select(*by, "table_no", "r", filled.alias("cells"))


def courses(rows: DataFrame, file: str, order: list[str], cells_col: str = "cells") -> DataFrame:
    """Rows of a file's tables in order as one table: (file, row_no, kind, cells). The first row, a header as a rule, gives the names
    of columns; headers that come again go. A row that says one thing and names a block of knowledge is marked as its header."""
    c = F.col(cells_col)
    header = F.arrays_overlap(c, F.array(*map(F.lit, HEADER_NAMES)))
    some = F.array_distinct(F.filter(c, lambda x: x != ""))
    block = (F.size(some) == 1) & F.coalesce(F.get(c, F.lit(0)).contains(BLOCK), F.lit(False))
    w = Window.partitionBy(file).orderBy(*order)
    at = rows.withColumn("_header", header).withColumn("_first", F.row_number().over(w) == 1).where(~F.col("_header") | F.col("_first"))
    marked = F.transform(c, lambda x, i: F.when(i == 0, F.concat(F.lit(BLOCK_MARK), x)).otherwise(""))
    kind = F.when(F.col("_first"), "header").when(block, "block").otherwise("row")
    return at.select(file, (F.row_number().over(w) - 1).alias("row_no"), kind.alias("kind"), F.when(block & ~F.col("_header"), marked).otherwise(c).alias("cells"))
