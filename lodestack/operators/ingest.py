"""Writing graphs: upserts, subtree replacement, comparison of trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_props(old: Column, new: Column) -> Column:
    """Old properties with the new ones over them."""
    none = F.expr("cast(map() as map<string,string>)")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def upserted_nodes(old: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("label", "id")) -> DataFrame:
    """Nodes (label, id, props) after a batch (with ``seq``): one row a key, later properties over earlier ones.

    A batch folds by key and property, the last writer of each property winning, before it meets the old nodes.
    """
    each = batch.select(*keys, "seq", F.explode_outer("props").alias("k", "v"))
    last = each.groupBy(*keys, "k").agg(F.max_by("v", "seq").alias("v"))
    folded = last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("_new"))
    both = old.join(folded, list(keys), "full_outer")
    return both.select(*keys, merged_props(F.col("props"), F.col("_new")).alias("props"))


def upserted_edges(old: DataFrame, batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, type) after a batch: each once, and only where both ends are nodes."""
    ids = nodes.select("id").distinct()
    good = batch.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return old.unionByName(good.select("src", "dst", "type")).dropDuplicates(["src", "dst", "type"])


def replaced(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The table with the rows of the batch's keys replaced by the batch: whole subtrees, by their root's key."""
    return table.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch.select(*table.columns))


def must_be_new(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The batch; fails if it has a key that the table has, or one twice."""
    clash = batch.join(table.select(key), key, "left_semi").select(key).limit(1).collect()
    twice = batch.groupBy(key).count().where("count > 1").select(key).limit(1).collect()
    if clash or twice:
        raise ValueError(f"not a new {key}: {(clash or twice)[0][0]}")
    return batch


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Paths at which two sets of (keys, path, value) differ, with both values; null-safe and by one full join."""
    a = left.withColumnRenamed("value", "left_value").withColumn("_l", F.lit(True))
    b = right.withColumnRenamed("value", "right_value").withColumn("_r", F.lit(True))
    both = a.join(b, [*keys, "path"], "full_outer")
    return both.where(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))).select(*keys, "path", "left_value", "right_value")


def first_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The first differing path of each key."""
    return differences(left, right, keys).groupBy(*keys).agg(F.min(F.struct("path", "left_value", "right_value")).alias("d")).select(*keys, "d.*")


def without_trees(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges without the trees of some roots (id), and (root, n) with the number of nodes that go.

    Trees end ``depth`` edges below their root, as regulations do at points: any level may be missing. A root that
    is no node goes with n 0. A node under two roots counts for both. All edges of nodes that go, go too.
    """
    at = nodes.join(roots, "id", "left_semi").select(F.col("id").alias("_0"))
    for d in range(depth):
        at = at.join(edges.select(F.col("src").alias(f"_{d}"), F.col("dst").alias(f"_{d + 1}")).distinct(), f"_{d}", "left")
    below = F.array_compact(F.array(*(f"_{d}" for d in range(depth + 1))))
    gone = at.select(F.col("_0").alias("root"), F.explode(below).alias("id")).distinct()
    ids = gone.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    counts = roots.select(F.col("id").alias("root")).distinct().join(gone.groupBy("root").agg(F.count("*").alias("n")), "root", "left")
    return nodes.join(ids, "id", "left_anti"), kept.select(*edges.columns), counts.select("root", F.coalesce("n", F.lit(0)).alias("n"))
