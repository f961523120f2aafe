"""Regulations: lines to chapters, articles, clauses and points, by running counts; lookups and text of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Glyphs that scanned regulations have in place of Roman numerals.
GLYPHS = (("IШ", "III"), ("І", "I"), ("Ⅴ", "V"), ("Х", "X"))


def repaired(line: Column) -> Column:
    for wrong, right in GLYPHS:
        line = F.replace(line, F.lit(wrong), F.lit(right))
    return F.trim(line)


def parts(lines: DataFrame, by: str = "doc_id", order: str = "pos", text_col: str = "line") -> DataFrame:
    """(by, pos, chapter, article, clause, point, level, text): each article, clause and point with its own text.

    Page numbers and blank lines go. An article's title runs on to the next line that could begin
    something; later lines belong to the last point, clause or article. Clauses count within articles,
    points within clauses; lines before the first article belong to nothing.
    """
    at = lines.select(by, order, repaired(F.col(text_col)).alias("t")).where((F.col("t") != "") & ~F.col("t").rlike(r"^\d{1,3}$"))
    t, doc = F.col("t"), Window.partitionBy(by).orderBy(order)
    article = t.rlike(r"(?iU)^[ĐD][iìíỉĩịeêềếểễệu]{2,4}\s+\d+") & ~F.lower("t").contains("xem") & ~t.rlike(r"(?iU)^[ĐD]\p{L}+\s+\d+\.?\s*\)")
    at = at.withColumn("is_chapter", t.rlike(r"(?iU)^Ch[uư]ơng\s+[IVXLCDM]+")).withColumn("is_article", ~F.col("is_chapter") & article)
    at = at.withColumn("chapter", F.last(F.when(F.col("is_chapter"), t), ignorenulls=True).over(doc)).withColumn("s", F.sum((F.col("is_chapter") | F.col("is_article")).cast("int")).over(doc))
    section = Window.partitionBy(by, "s").orderBy(order)
    at = at.withColumn("headed", F.first("is_article").over(section)).where("headed")
    at = at.withColumn("begun", F.sum((~F.col("is_article") & t.rlike(r"(?iU)^(?:\d+\.|[a-zđ]\)|[ĐD]|Ch[uư]ơng)")).cast("int")).over(section)).withColumn("free", ~F.col("is_article") & (F.col("begun") > 0))
    clause = F.when(F.col("free"), F.nullif(F.regexp_extract("t", r"^(\d+)\.\s+", 1), F.lit("")))
    at = at.withColumn("own_clause", clause).withColumn("c", F.count("own_clause").over(section))
    point = F.when(F.col("free") & (F.col("c") > 0), F.nullif(F.regexp_extract("t", r"^([a-zđ])\)\s+", 1), F.lit("")))
    within = Window.partitionBy(by, "s", "c").orderBy(order)
    at = at.withColumn("own_point", point).withColumn("p", F.count("own_point").over(within))
    body = F.when(F.col("is_article"), F.regexp_replace("t", r"(?U)^\p{L}+\s+\d+\.?\s*", "")).when(F.col("own_clause").isNotNull(), F.regexp_replace("t", r"^\d+\.\s+", "")).when(F.col("own_point").isNotNull(), F.regexp_replace("t", r"^[a-zđ]\)\s+", "")).otherwise(t)
    first = lambda c: F.min_by(c, order)
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("b")))), lambda x: x["b"]), " "))
    at = at.withColumn("article", F.first(F.regexp_extract("t", r"(?U)^\p{L}+\s+(\d+)", 1)).over(section)).withColumn("clause", F.first("own_clause").over(within))
    out = at.groupBy(by, "s", "c", "p").agg(F.min(order).alias(order), first("chapter").alias("chapter"), first("article").alias("article"), first("clause").alias("clause"), first("own_point").alias("point"), text.alias("text"))
    level = F.when(F.col("p") > 0, "point").when(F.col("c") > 0, "clause").otherwise("article")
    return out.select(by, order, "chapter", "article", "clause", "point", level.alias("level"), "text")


def looked_up(tree: DataFrame, references: DataFrame, by: str = "doc_id", order: str = "pos", separator: str = "\n\n---\n\n") -> DataFrame:
    """(query, context): the texts of what references (query, by, kind, chapter, article, clause, point) name, in order, each once.

    An article comes with its clauses and points, a clause with its points, a chapter with all of it.
    """
    r = references.select("query", F.col(by).alias("_d"), "kind", *(F.col(c).alias(f"_{c}") for c in ("chapter", "article", "clause", "point")))
    roman = F.regexp_extract(F.col("chapter"), r"(?iU)^Ch[uư]ơng\s+([IVXLCDM]+)", 1)
    same = lambda c: F.col(f"_{c}").isNull() | F.col(f"_{c}").eqNullSafe(F.col(c))
    hit = tree.join(r, (F.col(by) == F.col("_d")) & (F.col("_chapter").isNull() | (F.col("_chapter") == F.upper(roman))) & same("article") & same("clause") & same("point"))
    texts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct(F.col(order).alias("o"), "text")))), lambda x: x["text"]))
    return hit.groupBy("query").agg(F.array_join(texts, separator).alias("context"))


def resolved(references: DataFrame, tree: DataFrame, by: str = "doc_id") -> DataFrame:
    """References (id, by, article, clause, point; '' for none) with the most exact part that exists: target, null if there is none."""
    key = lambda a, *c: F.concat_ws("/", *(F.coalesce(F.col(f"{a}{x}"), F.lit("")) for x in c))
    there = tree.select(F.col(by).alias("_d"), F.concat_ws("/", "article", "clause", "point").alias("_k")).distinct()
    at, tries = references, []
    for n, parts_ in enumerate((("article", "clause", "point"), ("article", "clause"), ("article",))):
        one = there.toDF(f"_d{n}", f"_k{n}")
        complete = F.lit(True)
        for c in parts_:
            complete = complete & (F.coalesce(F.col(c), F.lit("")) != "")
        at = at.join(one, complete & (F.col(by) == F.col(f"_d{n}")) & (key("", *parts_) == F.col(f"_k{n}")), "left")
        tries.append(F.col(f"_k{n}"))
    return at.withColumn("target", F.coalesce(*tries)).drop(*(f"_{x}{n}" for n in range(3) for x in "dk"))


def sizes(tree: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, n_nodes, n_edges, n_articles) of each regulation's ``parts()`` as a graph: the regulation itself, its chapters,
    articles, clauses and points are nodes, each but the first with one edge to it."""
    below = F.count("*") + F.count_distinct("chapter")
    return tree.groupBy(by).agg((below + 1).alias("n_nodes"), below.alias("n_edges"), F.count_if(F.col("level") == "article").alias("n_articles"))


def regulation_name(first_title: Column, default: str = "Văn bản quy chế") -> Column:
    """What the first article of a decision says is issued with it, else its title; the default without one."""
    named = F.regexp_extract(first_title, r"(?s)Ban hành kèm theo Quyết định này\s+\"?(.+?)\"?$", 1)
    return F.coalesce(F.nullif(named, F.lit("")), first_title, F.lit(default))


def plain_text(tree: DataFrame, by: str = "doc_id", order: str = "pos", most: int = 12_000) -> DataFrame:
    """(by, n_chars, n_sections, preview) of each regulation's ``parts()``: its chapters' heads, the numbers of its articles and all texts in
    order, joined by blanks; its length, its articles, and what comes first of it.

    A part is put in its place by a running length, so that texts beyond the preview are never gathered.
    """
    doc = Window.partitionBy(by).orderBy(order)
    opens = F.col("chapter").isNotNull() & ~F.col("chapter").eqNullSafe(F.lag("chapter").over(doc))
    article = F.col("level") == "article"
    said = [F.when(opens, F.nullif(F.trim("chapter"), F.lit(""))), F.when(article, F.concat(F.lit("Điều "), "article")), F.nullif(F.trim("text"), F.lit(""))]
    at = tree.select(by, order, article.alias("is_article"), F.concat_ws(" ", *said).alias("said"))
    room = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.col("said") != "", F.length("said") + 1).otherwise(0)
    at = at.withColumn("size", size).withColumn("before", F.coalesce(F.sum("size").over(room), F.lit(0)))
    shown = F.when((F.col("size") > 0) & (F.col("before") < most), F.struct(F.col(order).alias("o"), "said"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["said"]), " ")
    return at.groupBy(by).agg(F.greatest(F.sum("size") - 1, F.lit(0)).alias("n_chars"), F.count_if("is_article").alias("n_sections"), F.left(text, F.lit(most)).alias("preview"))
