"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every document gets a random but fixed key. Within a source the keys are range-partitioned into
buckets; running sums within a bucket start from the sum of all earlier buckets, and the key at which
the source's budget is met is its cut. A document is then taken once for each whole epoch and once
more if its key lies below the cut: the texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm import common

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Documents in a bucket, and the most buckets of a source: a bucket grows only beyond 268 M documents of one source.
BUCKET_ROWS, MAX_BUCKETS = 4096, 65_536


def random_key(doc_id: Column) -> Column:
    """The MD5 of the id: a fixed random order that every engine can repeat."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, n, source_size) with its ``target``: the fixed point of resharing what exceeds ``most`` epochs.

    Sorted by how soon a source is full, the full ones come first; the k-th is full if its share of
    what the earlier ones leave exceeds its limit. One row for each source, so one task suffices.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    fullness = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fullness.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("weight", weight.cast("double")).withColumn("limit", (F.lit(most) * F.col("source_size")).cast("double"))
        .withColumn("left", F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("shared_by", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("shared_by"))
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("shared_by") * -1, "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("level") * F.col("weight")))
        .select("source", "n", "source_size", "target")
    )


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, key, size) of every row; size counts the words of the whole text, 0 for null."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        random_key(F.col(id_col)).alias("key"), common.n_words(F.col(text_col)).alias("size"),
    )


def plan(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, epochs, cut): a document is taken ``epochs`` times, and once more if key < cut.

    ``slim`` is a written table of ``sized()``. The document at the budget is taken if that brings the
    source nearer to its target; a cut of null takes none.
    """
    of = common.written(targets(slim.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights, most), "targets")
    of = of.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")).withColumn(
        "budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    buckets = F.greatest(F.lit(1), F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("n") / BUCKET_ROWS)))
    placed = _with(slim, of.select("source", buckets.alias("buckets")))
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2**32 * F.col("buckets")).cast("int")
    placed = common.written(placed.groupBy("source", bucket.alias("bucket"), "key").agg(F.sum("size").alias("size")), "keys")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("source", "bucket").agg(F.sum("size").alias("filled")).withColumn("start", F.coalesce(F.sum("filled").over(earlier), F.lit(0)))
    # a source's budget is met in one bucket, and only that bucket is sorted
    hit = _with(starts, of.select("source", "budget")).where("start <= budget and budget < start + filled")
    hit = common.written(hit.select("source", "bucket", "start", "budget"), "hit")
    within = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        _with(placed, hit, "source", "bucket")
        .withColumn("taken", F.col("start") + F.sum("size").over(within) - F.col("size") / 2 <= F.col("budget"))
        .groupBy("source").agg(F.coalesce(F.min(F.when(~F.col("taken"), F.col("key"))), F.concat(F.max("key"), F.lit("z"))).alias("cut"))
    )
    return common.written(_with(of, cuts, "source", how="left").select("source", "source_size", "target", "epochs", "cut"), "mix-plan")


def _with(rows: DataFrame, per_source: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """Joins what each source has, null sources too; broadcast only if counted to be few."""
    on = on or ("source",)
    other = common.maybe_broadcast(per_source.withColumnsRenamed({c: f"_{c}" for c in on}))
    return rows.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on], how).drop(*(f"_{c}" for c in on))


def times() -> Column:
    """How often a row with key, epochs and cut is taken."""
    return F.col("epochs") + F.coalesce(F.col("key") < F.col("cut"), F.lit(False)).cast("int")


def takes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken.

    Null sources are one source, last in order; null texts have size 0 and are taken with size 0; rows
    of one id share a key and so a decision; an empty table gives no rows. Reruns agree.
    """
    slim = common.written(sized(docs, id_col, text_col, source_col), "sized")
    return _with(slim, plan(slim)).select("doc_id", "size", "source_size", "target", (F.col("size") * times()).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix with all columns of ``docs``, whatever their names, each as often as it is taken; texts are not shuffled."""
    source, epochs, cut, n = common.fresh(docs, "mix_source", "mix_epochs", "mix_cut", "mix_times")
    chosen = plan(common.written(sized(docs, id_col, text_col, source_col), "sized")).select(F.col("source").alias(source), F.col("epochs").alias(epochs), F.col("cut").alias(cut))
    times_ = F.col(epochs) + F.coalesce(random_key(F.col(id_col)) < F.col(cut), F.lit(False)).cast("int")
    out = docs.join(common.maybe_broadcast(chosen), F.col(source_col).cast("string").eqNullSafe(F.col(source))).withColumn(n, times_).where(F.col(n) > 0)
    return out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(source, epochs, cut, n)
