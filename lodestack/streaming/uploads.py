"""Ingestion of uploaded files as a stream: a file source, a handler for each batch, a progress table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PROGRESS = "batch long, status string, rows long, error string, at timestamp"


# What may be uploaded.
CATEGORIES = ("chuyen_nganh_dao_tao", "quy_che_hoc_vu", "huong_dan_thu_tuc", "thong_bao_ke_hoach")
MOST_BYTES = 50 * 1024 * 1024


def refused(name: Column, category: Column, size: Column, categories: tuple[str, ...] = CATEGORIES, most: int = MOST_BYTES) -> Column:
    """Why a file may not be taken, the first reason that holds; null if it may."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "name missing").when(~F.coalesce(category.isin(*categories), F.lit(False)), "unknown category")
        .when(~F.lower(name).endswith(".pdf"), "no pdf").when(F.coalesce(size, F.lit(0)) > most, "too large")
    )


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size) of the files under a folder, whose contents are not read."""
    at = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return at.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("size"))


def ingest(spark: SparkSession, folder: str, schema: str, handler: Callable[[DataFrame, int], DataFrame], out: str, progress: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Starts a run over the files that are there: each micro-batch goes through ``handler`` and is written
    under its own number, so that a batch that runs again overwrites itself. What a handler raises is noted
    and does not stop the stream."""

    def note(batch: int, status: str, rows: int, error: str | None) -> None:
        row = spark.createDataFrame([(batch, status, rows, error, None)], PROGRESS).withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("overwrite").parquet(f"{progress}/batch={batch}/{status}")

    def run(df: DataFrame, batch: int) -> None:
        note(batch, "processing", 0, None)
        try:
            path = f"{out}/batch={batch}"
            handler(df, batch).write.mode("overwrite").parquet(path)
            note(batch, "completed", spark.read.parquet(path).count(), None)
        except Exception as fault:  # the batch failed; the next ones go on
            note(batch, "failed", 0, str(fault)[:500])

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status(spark: SparkSession, progress: str) -> DataFrame:
    """The last status of each batch."""
    rows = spark.read.schema(PROGRESS.replace("batch long, ", "")).option("recursiveFileLookup", "true").parquet(progress)
    rows = rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)", 1).cast("long"))
    rank = F.when(F.col("status") == "processing", 0).otherwise(1)
    return rows.groupBy("batch").agg(F.max_by(F.struct("status", "rows", "error"), F.struct("at", rank)).alias("s")).select("batch", "s.*")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by tumbling window, for batch and stream alike: rows later than ``late`` are left out of a stream."""
    at = events.withWatermark("ts", late) if events.isStreaming else events
    return at.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
