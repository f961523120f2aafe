"""Exact token counts: a histogram of encoded lengths, and suffix sums over it.

Each document becomes one number; documents of equal length become one row. What a context limit keeps
follows from that row's suffix: texts at least as long count with the limit, shorter ones in full.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm import common
from lodestack.llm.tokenizing import batch_tokenizer, parts

#: Lengths in a bucket of the two-level suffix sums.
SPAN = 1024


def lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = batch_tokenizer(tokenizer).encode
        for x in batches:
            n = [np.diff(tokenize(x.column(1).slice(a, b - a))[1]) for a, b in parts(x.column(1))]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], names=["doc_id", "n_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.bound_batches(slim).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) of ``lengths()``, as a written table: one row for each length."""
    return common.written(counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "length-histogram")


def limits(hist: DataFrame, also: Sequence[int] = ()) -> DataFrame:
    """For every length that occurs, and every one in ``also``, as a context limit: docs_at_least, tokens_at_least,
    kept_tokens (each text cut at the limit), lost_tokens, share_below (of documents shorter than it) and
    share_upto (of documents no longer: the q-quantile is the first limit with a share of q or more).

    Between two lengths that occur all totals but kept_tokens are those of the longer one; ``also`` names
    limits that no document has. Suffix sums run within buckets of lengths and start from the sums of the
    longer buckets. Documents of equal length, and rows that repeat, count each; an empty table gives no rows
    but those of ``also``, whose shares are null.
    """
    if also:
        more = hist.sparkSession.createDataFrame([(int(x), 0) for x in also], "n_tokens long, n_docs long")
        hist = hist.select("n_tokens", "n_docs").unionByName(more).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    at = hist.withColumn("bucket", F.floor(F.col("n_tokens") / SPAN))
    per = at.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    longer = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    every = Window.partitionBy()
    per = per.select(
        "bucket", F.coalesce(F.sum("d").over(longer), zero).alias("d"), F.coalesce(F.sum("t").over(longer), zero).alias("t"),
        F.sum("d").over(every).alias("docs"), F.sum("t").over(every).alias("tokens"),
    )
    suffix = Window.partitionBy("bucket").orderBy(F.desc("n_tokens"))
    out = at.join(per, "bucket").select(
        "n_tokens", "n_docs", "docs", "tokens",
        (F.col("d") + F.sum("n_docs").over(suffix)).alias("docs_at_least"),
        (F.col("t") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(suffix)).alias("tokens_at_least"),
    )
    lost = F.col("tokens_at_least") - F.col("docs_at_least") * F.col("n_tokens")
    return out.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("tokens") - lost).alias("kept_tokens"), lost.alias("lost_tokens"),
        (1 - F.try_divide("docs_at_least", "docs")).alias("share_below"), (1 - F.try_divide(F.col("docs_at_least") - F.col("n_docs"), "docs")).alias("share_upto"),
    )


def quantiles(hist: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least that share of the documents do not exceed; none of an empty table."""
    wanted = hist.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")  # as few as were asked for
    run = limits(hist)
    return run.join(F.broadcast(wanted), F.col("share_upto") >= F.col("share") - 1e-12).groupBy("share").agg(F.min("context_limit").alias("n_tokens"))
