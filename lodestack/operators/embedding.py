"""Vectors for texts by a function handed in: only what has none yet, in batches bounded by bytes, to be taken up again after a loss."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import spaced
from lodestack.sources.shared import spread

#: Takes a list of texts and returns an array of one row of numbers for each.
Embedder = Callable[[list[str]], np.ndarray]
#: Bytes of an Arrow batch, and texts that are handed over at once.
BATCH_BYTES, TEXTS = 4 << 20, 64


def bounded(df: DataFrame, size: int = BATCH_BYTES) -> DataFrame:
    """``df``, after bounding the bytes of the session's Arrow batches; a bound that is there stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    plain = re.fullmatch(r"(-?\d+)b?", df.sparkSession.conf.get(key, str(2**31 - 1)), re.I)
    if plain and not 0 < int(plain[1]) <= 64 << 20:
        df.sparkSession.conf.set(key, str(size))
    return df


def missing(nodes: DataFrame, stored: DataFrame | None = None, id_col: str = "id", text_col: str = "text", force: bool = False) -> DataFrame:
    """Nodes with a text that have no stored vector, or all with a text if forced. Blank texts never; of rows that repeat an id
    one counts. ``stored`` has the ids that have vectors; a vector of null is none."""
    at = nodes.where((spaced(F.col(text_col)) != "") & F.col(id_col).isNotNull()).dropDuplicates([id_col])
    if stored is None or force:
        return at
    return at.join(stored.where(F.col("embedding").isNotNull()).select(id_col), id_col, "left_anti")


def embedded(nodes: DataFrame, embed: Embedder, dims: int, id_col: str = "id", text_col: str = "text", texts: int = TEXTS) -> DataFrame:
    """(id, embedding) of nodes with a text, as vectors of length one. What ``embed`` returns must have ``dims`` numbers for each
    text, all finite and not all zero; anything else is an error of the task."""
    kind = dict(nodes.dtypes)[id_col]

    def unit(batch: list[str]) -> np.ndarray:
        v = np.asarray(embed(batch), np.float64)
        if v.shape != (len(batch), dims):
            raise ValueError(f"embedder: shape {v.shape}, not {(len(batch), dims)}")
        size = np.sqrt((v * v).sum(axis=1, keepdims=True))
        if not (np.isfinite(v).all() and (size > 0).all()):
            raise ValueError("embedder: a vector that is not finite or all zeros")
        return v / size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, texts):
                part = batch.slice(at, texts)
                flat = unit(part.column(1).to_pylist()).ravel()
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dims)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], names=[id_col, "embedding"])

    return bounded(nodes).select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, embedding array<double>")


def vectors(spark: SparkSession, path: str, id_type: str = "string", id_col: str = "id") -> DataFrame:
    """The stored vectors at a path, none if there is nothing yet."""
    schema = f"{id_col} {id_type}, embedding array<double>"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def embed_into(nodes: DataFrame, path: str, embed: Embedder, dims: int, id_col: str = "id", text_col: str = "text", steps: int = 16) -> DataFrame:
    """Appends vectors of all nodes that have none to a path, step by step by the hash of the id, and returns all that are stored.

    Each step is one committed write: a run that was ended goes on with what is missing, and has lost one step at most.
    """
    spark, kind = nodes.sparkSession, dict(nodes.dtypes)[id_col]
    for step in range(steps):
        part = nodes.where(F.pmod(F.xxhash64(id_col), F.lit(steps)) == step)
        todo = missing(part, vectors(spark, path, kind, id_col), id_col, text_col)
        embedded(todo, embed, dims, id_col, text_col).write.mode("append").parquet(path)
    return vectors(spark, path, kind, id_col)


def coverage(nodes: DataFrame, stored: DataFrame, by: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The report by label: nodes, those with a text, those with a vector, and the distinct sizes of vectors."""
    at = nodes.join(stored.select(id_col, "embedding"), id_col, "left")
    return at.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(spaced(F.col(text_col)) != "").alias("with_text"), F.count("embedding").alias("embedded"),
        F.count_distinct(F.when(F.col("embedding").isNotNull(), F.size("embedding"))).alias("sizes"),
    )


def notice_texts(sections: DataFrame, tables: DataFrame, rows: DataFrame, notices: DataFrame) -> DataFrame:
    """(notice_id, id, label, text): the distinct sections and rows below each of ``notices (id)`` that have a text."""
    ids = notices.select(F.col("id").alias("notice_id")).distinct()
    own = sections.select("id", "notice_id", "text").join(ids, "notice_id", "left_semi")
    owned = tables.select(F.col("id").alias("table_id"), "section_id").join(own.select(F.col("id").alias("section_id"), "notice_id"), "section_id")
    below = rows.select("id", "table_id", "text").join(owned, "table_id")
    label = lambda df, name: df.select("notice_id", "id", F.lit(name).alias("label"), "text")
    every = label(own, "section").unionByName(label(below, "row")).where(spaced(F.col("text")) != "")
    return spread(every, ["notice_id", "id"], sections.count() + rows.count(), 250_000).distinct()
