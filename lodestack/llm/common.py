"""What the operators of this subpackage share: the shared folder, written tables, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Largest table, in rows and bytes, that is ever broadcast; wider ones go through a shuffled join.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64 << 20
#: Keys that can be hot at most, whatever the table's size.
HOT_KEYS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session has none (tests on one machine) a temporary folder is set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if (there := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestack-"))
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestack/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Removes the intermediate tables that this application has written; to be called when their results have been used."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there and lost executors cost nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """``df``, after bounding the bytes of the session's Arrow batches: ten thousand long texts would not fit a task.

    A bound that the session already has stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    plain = re.fullmatch(r"(-?\d+)b?", df.sparkSession.conf.get(key, str(2**31 - 1)), re.I)
    if plain and not 0 < int(plain[1]) <= 64 << 20:
        df.sparkSession.conf.set(key, str(size))
    return df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has at most so many rows, and in all no more than BROADCAST_BYTES as text."""
    few = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("size")).first()
    return few["n"] <= rows and few["size"] <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast only after counting; a larger table is left to a sort-merge join, whose skew AQE splits."""
    return F.broadcast(df) if small(df, rows) else df.hint("merge")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hot_rows(total: int) -> int:
    """Rows from which a key counts as hot: fewer than ``HOT_KEYS`` keys of ``total`` rows can have more."""
    return max(1024, -(-total // HOT_KEYS))


def hot_join(rows: DataFrame, few: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with ``few``, which has one row for each key and in ``size`` its number of rows, of ``total`` in all.

    Hot keys, fewer than ``HOT_KEYS``, meet their rows where these are; the others in a sort-merge join.
    """
    most = hot_rows(total)
    hot = few.where(F.col(size) > most)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(few.where(F.col(size) <= most).hint("merge"), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys))


def scanned(items: Column, start: Column, step: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """The accumulators after each item of an array. Chunks keep the cost of growing arrays linear in all but very long ones."""
    empty = F.slice(F.array(start), F.lit(1), F.lit(0))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / chunk).cast("int")), lambda c: F.slice(items, c * chunk + 1, F.lit(chunk)))

    def one(acc: Column, x: Column) -> Column:
        now = step(acc["last"], x)
        return F.struct(now.alias("last"), F.concat(acc["done"], F.array(now)).alias("done"))

    def part(acc: Column, xs: Column) -> Column:
        got = F.aggregate(xs, F.struct(acc["last"].alias("last"), empty.alias("done")), one)
        return F.struct(got["last"].alias("last"), F.concat(acc["parts"], F.array(got["done"])).alias("parts"))

    begin = F.struct(start.alias("last"), F.slice(F.array(empty), F.lit(1), F.lit(0)).alias("parts"))
    return F.when(F.size(items) > 0, F.aggregate(chunks, begin, part, lambda acc: F.flatten(acc["parts"]))).otherwise(empty)


def words(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
