"""Graphs as edges (src, dst, type): closures, neighbourhoods, bounded paths and caps.

Depths are bounded by the caller and each step is one equi-join, so plans do not loop over data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.sources.shared import dealt_join, written


def descent(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Every path down from roots (id): root, id, depth, path; cycles end where a node would repeat."""
    level = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.array("id").alias("path"))
    levels = [level]
    step = edges.select(F.col("src").alias("id"), "dst")
    for d in range(1, depth + 1):
        level = level.join(step, "id").where(~F.array_contains("path", F.col("dst")))
        level = level.select("root", F.col("dst").alias("id"), F.lit(d).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def shallowest(paths: DataFrame) -> DataFrame:
    """Of the paths to each id the shortest, of equal ones the first in order; a partial aggregate."""
    return paths.groupBy("id").agg(F.min_by("path", F.struct("depth", "path")).alias("path"), F.min("depth").alias("depth"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected steps (a, b, edge, type)."""
    e = edges.select("src", "dst", F.concat_ws("|", "src", "type", "dst").alias("edge"), "type")
    return e.toDF("a", "b", "edge", "type").unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"), "edge", "type"))


def within(edges: DataFrame, goals: DataFrame, hops: int) -> DataFrame:
    """Ids within so many undirected steps of goals (id), goals included."""
    step = both_ways(edges).select(F.col("a").alias("id"), "b").distinct()
    near = goals.select("id").distinct()
    for _ in range(hops):
        near = near.unionByName(near.join(step, "id").select(F.col("b").alias("id"))).distinct()
    return near


def expanded(edges: DataFrame, seeds: DataFrame, depth: int, hints: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Undirected paths of 1 to depth edges, none twice, from seeds (id): seed, nodes, edges, types, depth.

    Seeds without a path have one row of depth 0. With hints only paths with an edge of such a type count;
    where no path at all has one, hints do not count.

    ``most`` is for callers that keep no more than so many paths of a seed, in order of depth and then nodes.
    Of each node only the first steps in that order are taken, and of each seed and depth the first paths;
    a seed that has more of one depth needs no deeper ones, so that nothing that is kept is lost.
    """
    step = both_ways(edges)
    level = seeds.select(F.col("id").alias("seed"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.array().cast("array<string>").alias("types"), F.col("id").alias("a"))
    levels = []
    for d in range(depth):
        taken = step
        if most is not None:
            # ranked by the key of the join that follows, so that it is one shuffle for both
            taken = step.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy("b", "edge"))).where(F.col("_r") <= most + d).drop("_r")
        # a hub meets all that has come to it: its pairs are dealt out
        level = (level.join(taken, "a") if most is not None else dealt_join(level, taken, ["a"])).where(~F.array_contains("edges", F.col("edge")))
        level = level.select("seed", F.concat("nodes", F.array("b")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges"), F.concat("types", F.array("type")).alias("types"), F.col("b").alias("a"))
        if most is not None:
            first = Window.partitionBy("seed").orderBy(F.array_join("nodes", ">"), "edges")
            level = level.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most).drop("_r")
        if most is None and d + 1 < depth:
            level = written(level, "paths")
        levels.append(level)
    paths = reduce(DataFrame.unionByName, levels).drop("a")
    # a path has its first step among the paths too, and need not meet its seed again
    begun = levels[0].select("seed").distinct() if levels and not hints else None
    if hints:
        hinted = F.exists("types", lambda t: t.isin(*hints))
        any_hinted = F.broadcast(paths.agg(F.coalesce(F.bool_or(hinted), F.lit(False)).alias("_any")))  # one row
        paths = paths.join(any_hinted).where(~F.col("_any") | hinted).drop("_any")
    begun = paths.select("seed").distinct() if begun is None else begun
    none = F.array().cast("array<string>")
    alone = seeds.select(F.col("id").alias("seed")).join(begun, "seed", "left_anti").select("seed", F.array("seed").alias("nodes"), none.alias("edges"), none.alias("types"), F.lit(0).alias("depth"))
    return paths.select("seed", "nodes", "edges", "types", F.size("edges").alias("depth")).unionByName(alone)


def capped(paths: DataFrame, order: list[Column], max_paths: int, max_nodes: int) -> DataFrame:
    """Nodes of the first paths in order: (id, first) with the place they first stand at, at most so many, seeds always.

    Both caps are hard; the paths are cut before anything is ordered as a whole.
    """
    first = paths.orderBy(*order).limit(max_paths)
    numbered = first.withColumn("p", F.row_number().over(Window.orderBy(*order)))
    nodes = numbered.select("p", "seed", F.posexplode("nodes").alias("i", "id")).groupBy("id").agg(F.min(F.struct("p", "i")).alias("first"), F.max(F.col("id") == F.col("seed")).alias("is_seed"))
    nodes = nodes.withColumn("n", F.row_number().over(Window.orderBy("first")))
    return nodes.where((F.col("n") <= max_nodes) | F.col("is_seed")).select("id", "n", "is_seed")


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    ends = nodes.select("id").distinct()
    at = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi")
    return at.join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")


def seeds(nodes: DataFrame, keywords: list[str], props: list[str], bias: Column, k: int) -> DataFrame:
    """Nodes that have a keyword in a property: most distinct keywords first, then by bias, then by id.

    Keywords are few and given with the query: each is a test on the row, so there is no join.
    """
    words = list({w.strip().lower(): w.strip() for w in reversed(keywords) if w.strip()}.values())[::-1][:8]
    text = [F.lower(F.coalesce(F.col(p).cast("string"), F.lit(""))) for p in props]
    hits = F.array_compact(F.array(*(F.when(reduce(Column.__or__, [t.contains(w.lower()) for t in text]), F.lit(w)) for w in words)))
    at = nodes.withColumn("hits", hits).where(F.size("hits") > 0).withColumn("bias", bias)
    return at.orderBy(F.desc(F.size("hits")), F.desc("bias"), "id").limit(k)


def orphans(nodes: DataFrame, edges: DataFrame, kind: str | None = None) -> DataFrame:
    """Nodes that no edge (of a type) leads to."""
    to = edges if kind is None else edges.where(F.col("type") == kind)
    return nodes.join(to.select(F.col("dst").alias("id")), "id", "left_anti")


#: What a text of a graph is, if it is empty or cut.
NO_GRAPH, CUT_GRAPH = "[GRAPH RESULT]\nKhông có dữ liệu phù hợp.", "\n...<truncated>"


def serialised(nodes: DataFrame, edges: DataFrame, by: str, most: int = 12_000) -> DataFrame:
    """(by, text, cut) of each subgraph: nodes (by, place, id, label, name, props) as lines, then edges (by, src, type, dst) by the names of
    their ends, cut after ``most`` characters. Lines beyond these are not gathered. Edges without both ends are left out."""
    named = nodes.select(by, "id", "name")
    ends = edges.join(named.select(by, F.col("id").alias("src"), F.col("name").alias("from_name")), [by, "src"]).join(named.select(by, F.col("id").alias("dst"), F.col("name").alias("to_name")), [by, "dst"])
    about = F.when(F.coalesce("props", F.lit("")) != "", F.concat(F.lit(" ("), "props", F.lit(")"))).otherwise("")
    lines = nodes.select(by, F.lit(0).alias("part"), F.col("place").cast("string").alias("a"), F.lpad(F.col("place").cast("string"), 12, "0").alias("o"), F.concat(F.lit("- "), "label", F.lit(": "), "name", about).alias("line"))
    linked = ends.select(by, F.lit(1).alias("part"), F.col("type").alias("a"), F.concat_ws("\u0001", "src", "type", "dst").alias("o"), F.concat(F.lit("- "), "from_name", F.lit(" -["), "type", F.lit("]-> "), "to_name").alias("line"))
    w = Window.partitionBy(by).orderBy("part", "o")
    at = lines.unionByName(linked).withColumn("_n", F.row_number().over(w)).withColumn("_first", (F.col("part") == 1) & (F.lag("part").over(w) == 0))
    at = at.withColumn("line", F.when(F.col("_first"), F.concat(F.lit("\nCác quan hệ chính:\n"), "line")).otherwise(F.col("line")))
    at = at.withColumn("_before", F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_before") <= most)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "\n")
    whole = at.groupBy(by).agg(F.concat(F.lit("[GRAPH RESULT]\nCác nút liên quan:\n"), body).alias("whole"))
    cut = F.length("whole") > most
    return whole.select(by, F.when(cut, F.concat(F.substring("whole", 1, most), F.lit(CUT_GRAPH))).otherwise(F.col("whole")).alias("text"), cut.alias("cut"))
