"""Intermediate results that several branches of a plan need: written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of the largest table that is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64 << 20


def folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``; only on one machine, without that, a temporary one."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestack-"))
        there = spark.sparkContext.getCheckpointDir()
    return f"{there.rstrip('/')}/lodestack/{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: branches read it instead of working it out anew, and lineage ends there."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a hint: broadcast if it has been counted to be small, else a sort-merge join."""
    few = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if few["n"] <= rows and few["size"] <= BROADCAST_BYTES else df.hint("merge")


def spread(df: DataFrame, keys: list[str], rows: int, per_task: int = 500_000) -> DataFrame:
    """``df`` dealt by ``keys`` into as many tasks as ``rows``, counted before, need at ``per_task`` each: a task's memory does not grow
    with the input where the session's number of partitions is fixed."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(50_000, max(least, -(-rows // per_task))), *keys)


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], pairs: int = 2_000_000) -> DataFrame:
    """An inner join by ``keys`` for results that are far larger than both sides: a key's pairs are counted, and its rows dealt into
    blocks of about so many pairs, so that neither a key nor a small input puts a large result into one task."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    size = n(left, "_l").join(n(right, "_r"), keys).withColumn("_b", F.ceil(F.col("_l") * F.col("_r") / pairs).cast("int"))
    size = size.withColumn("_bl", F.least("_l", "_b").cast("int")).withColumn("_br", F.ceil(F.col("_b") / F.col("_bl")).cast("int")).select(*keys, "_l", "_r", "_bl", "_br")
    size = written(size, "pairs")
    total = size.agg(F.coalesce(F.sum((F.col("_l") * F.col("_r")).cast("double")), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum(F.col("_l") * F.col("_br") + F.col("_r") * F.col("_bl")), F.lit(0)).alias("rows")).first()
    # a number of its own: partitions of small sides would be made one
    tasks = int(max(1, min(20_000, total["pairs"] // pairs + total["rows"] // 1_000_000 + 1)))
    few = maybe_broadcast(size.select(*keys, "_bl", "_br"))
    own = lambda df, k: F.pmod(F.xxhash64(*df.columns), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    a = left.join(few, keys).withColumn("_i", own(left, "_bl")).withColumn("_j", every("_br")).drop("_bl", "_br")
    b = right.join(few, keys).withColumn("_j", own(right, "_br")).withColumn("_i", every("_bl")).drop("_bl", "_br")
    by = [*keys, "_i", "_j"]
    return a.repartition(tasks, *by).join(b.repartition(tasks, *by).hint("merge"), by).drop("_i", "_j")


def discard(spark: SparkSession) -> None:
    """Removes what this application has written, once its results have been used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
