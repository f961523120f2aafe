"""The registered queries of this subpackage: thin callers of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import chat_format, collocations, exact_dedup, language_id, line_dedup, mixing, packing, pii, prefix_trie, quality_rules, simhash_dedup, token_counts, warc
from lodestack.llm.common import documents
from lodestack.llm.tokenizing import default_path


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents: how many of each go, and which."""
    return line_dedup.verdicts(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by digest, entered into a new index in two batches."""
    docs = documents(spark, sf_dir)
    return exact_dedup.in_batches(docs, exact_dedup.fresh_index(spark, docs=docs))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdicts of all documents, with the rates of their hosts (``source``)."""
    return quality_rules.judged(documents(spark, sf_dir)).drop("host")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, by kind and as spans."""
    return pii.digests(pii.spans(documents(spark, sf_dir)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, by piece."""
    return packing.packed(documents(spark, sf_dir), default_path())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken, by words."""
    return mixing.takes(documents(spark, sf_dir))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as transcripts, parsed by models that have not seen them; ``label`` is the table's role."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    labels = said.groupBy(F.col("conv_id").alias("c"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("t")).agg(F.min("role").alias("label"))
    parsed = chat_format.held_out(said)
    return parsed.join(labels, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left").drop("c", "t")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents, with totals for each length and for powers of two."""
    return token_counts.limits(token_counts.histogram(token_counts.lengths(documents(spark, sf_dir), default_path())), [1 << k for k in range(8, 21)])


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits of a crawl log of all pages."""
    answers = warc.resolved(warc.crawl_log(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), "&")
    return answers.select(F.col("record_id").alias("page_id"), "url", F.col("response_id").alias("response_page_id"), "status", headers.alias("headers"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by fingerprint and by component of linked fingerprints."""
    return simhash_dedup.classes(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations."""
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of three quarters of them."""
    return language_id.identified(documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of two to four words that go together, by language, in all documents."""
    return collocations.collocations(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_exact_dedup, op3_quality_rules, op4_pii, op5_packing, op6_mixing, op7_chat_format,
        op8_token_counts, op9_warc_revisits, op10_simhash_dedup, op11_prefix_trie, op12_language_id, op13_collocations, pipeline,
    )
}
