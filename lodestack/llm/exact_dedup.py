"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

A batch is reduced to digests, one row for each text. The index is read bucket by bucket, never
shuffled: a sort-merge anti-join with the batches before it leaves the batch's new digests, and all of its
digests are appended under its name, so that a batch which runs again replaces itself. Texts never meet
the index.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm import common


#: Texts that a bucket of an index is sized for: 48 bytes each, sorted within one task.
BUCKET_TEXTS = 1 << 20


@F.arrow_udf(T.BinaryType())
def text_digest(text: pa.Array) -> pa.Array:
    """SHA-256 of the UTF-8 bytes with A-Z lower-cased; null counts as empty."""
    sha = hashlib.sha256
    return pa.array([sha((t or "").encode().lower()).digest() for t in text.to_pylist()], pa.binary())


class DigestIndex:
    """A table ``(digest, own_id, rows, seq)`` in partitions by batch: one row for each text of each batch, with
    the batch's largest id of it and its number of copies; ``seq`` is the batch's place in order of first entry.

    Which batch brought a text is worked out when it is asked for: the first that still holds it. The number
    of buckets is fixed for the life of an index and stored beside it; an index that exists is opened with
    its own, and asking for another is an error. Size it so that a bucket of digests fits a task (64
    buckets of 4 M digests are about 250 M texts).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = self._stored(buckets)
        self.table = f"digest_index_{hashlib.md5(path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, own_id BIGINT, rows BIGINT, seq BIGINT, batch STRING) "
            f"USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/rows'"
        )
        self._folder("rows", lambda fs, folder: fs.mkdirs(folder))
        spark.catalog.recoverPartitions(self.table)

    def _folder(self, name: str, act: Callable) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        act(folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder)

    def _kept(self, name: str, schema: str) -> DataFrame:
        """A small table beside the index, empty if it is not there yet."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # no such folder: a new index
            return self.spark.createDataFrame([], schema)

    def _keep(self, name: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _stored(self, buckets: int | None) -> int:
        there = self._kept("meta", "buckets int").first()
        if there is None:
            self._keep("meta", (buckets or 64,), "buckets int")
            return buckets or 64
        if buckets not in (None, there["buckets"]):
            raise ValueError(f"the index has {there['buckets']} buckets, not {buckets}")
        return there["buckets"]

    def _place(self, batch: str) -> int:
        """The batch's place: that of its first entry, also when it runs again or has become empty."""
        batches = self._kept("batches", "batch string, seq long")
        at = batches.agg(F.min(F.when(F.col("batch") == batch, F.col("seq"))).alias("own"), F.coalesce(F.max("seq"), F.lit(0)).alias("last")).first()
        if at["own"] is not None:
            return at["own"]
        self._keep("batches", (batch, at["last"] + 1), "batch string, seq long")
        return at["last"] + 1

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _replace(self, rows: DataFrame, batch: str) -> None:
        key = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "dynamic")
        try:
            spread = rows.repartition(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))
            spread.select("digest", "own_id", "rows", "seq", F.lit(batch).alias("batch")).write.insertInto(self.table, overwrite=True)
        finally:
            self.spark.conf.set(key, before)

    def _remove(self, batch: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (batch = {_quoted(batch)})")

    def totals(self, digests: DataFrame) -> DataFrame:
        """(digest, keep_id, group_size, seq) of those of ``digests`` that are in the index: the id and the place of the
        first batch that holds the text, and the rows of all."""
        hits = self.rows().join(digests.select("digest").distinct().hint("merge"), "digest", "left_semi")
        return hits.groupBy("digest").agg(F.min_by("own_id", "seq").alias("keep_id"), F.sum("rows").alias("group_size"), F.min("seq").alias("seq"))

    def add(self, slim: DataFrame, batch: str) -> DataFrame:
        """Enters ``slim (doc_id, digest, rows)`` as a batch and returns its new texts as (digest, own_id).

        New is what the anti-join with the batches before it leaves. A batch that runs again replaces its
        rows, all of them, also if it has fewer texts now, or none.
        """
        seq = self._place(batch)
        groups = common.written(slim.groupBy("digest").agg(F.max("doc_id").alias("own_id"), F.sum("rows").alias("rows")), "digest-groups")
        # dynamic overwriting leaves a partition that gets no rows
        if groups.isEmpty():
            self._remove(batch)
            self._folder(f"rows/batch={_escaped(self.spark, batch)}", lambda fs, folder: fs.delete(folder, True))
        else:
            self._replace(groups.withColumn("seq", F.lit(seq).cast("long")), batch)
        new = groups.select("digest", "own_id")
        if seq > 1:
            new = new.hint("merge").join(self.rows().where(F.col("seq") < seq).select("digest"), "digest", "left_anti")
        return new

    def compact(self) -> None:
        """Folds all batches into one partition with one file a bucket; batches that it holds cannot run again."""
        at = self.rows().groupBy("digest").agg(F.min_by("own_id", "seq").alias("own_id"), F.sum("rows").alias("rows"), F.min("seq").alias("seq"))
        old = [r[0] for r in self.rows().select("batch").distinct().collect()]  # as many as there are batches
        self._replace(common.written(at, "compacted"), f"base-{uuid.uuid4().hex}")
        for batch in old:
            self._remove(batch)
            # an external table keeps a dropped partition's folder, and reopening must not find it
            self._folder(f"rows/batch={_escaped(self.spark, batch)}", lambda fs, folder: fs.delete(folder, True))


def _quoted(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _escaped(spark: SparkSession, name: str) -> str:
    """A partition's value as its folder spells it."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, rows) as a written table: rows of one id and text are one."""
    at = common.bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))
    return common.written(at.groupBy("digest", "doc_id").agg(F.count("*").alias("rows")), "digests")


def judged(slim: DataFrame, found: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``slim (doc_id, digest, rows, seq)`` with the totals of their digests; a row stays if its text was
    ``new (digest, own_id, seq)`` in its batch and its id is the largest there."""
    own = new.withColumnsRenamed({"seq": "new_in"})
    found = common.written(found.select("digest", "keep_id", "group_size").join(own, "digest", "left"), "digest-totals")
    total = found.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    first = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("nth") == 1) & F.coalesce(F.col("new_in") == F.col("seq"), F.lit(False))
    at = common.hot_join(slim, found, ["digest"], "group_size", total).select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("nth"))
    return at.select("doc_id", "keep_id", "group_size", first.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def verdicts(docs: DataFrame, index: DigestIndex, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts of a batch the row with the largest id stays; a text that an earlier batch holds stays
    with that batch's row; group_size counts all batches so far. A batch that runs again under its name
    replaces itself, in its place; texts that it no longer has stay with the next batch that has them, when
    that is asked again. Null texts are empty texts. Of rows that repeat both id and text, one is kept. An id
    of null stays only if its whole group has none. An empty batch leaves no rows in the index.
    """
    batch = batch or uuid.uuid4().hex
    slim = digests(docs, id_col, text_col)
    new = index.add(slim, batch)
    one = F.lit(1).alias("seq")
    return judged(slim.select("*", one), index.totals(slim), new.select("*", one))


def in_batches(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``verdicts`` of a whole table that enters the index in two batches: the larger half of the ids, then the rest.

    Larger ids come first, so that still the largest id of all stays.
    """
    key = F.col(id_col).cast("long")
    middle = docs.agg(F.floor((F.min(key) / 2 + F.max(key) / 2)).alias("m")).first()["m"]
    later = F.coalesce(key < F.lit(middle), F.lit(True))
    slim = new = None
    for place, half in ((1, docs.where(~later)), (2, docs.where(later))):
        part = digests(half, id_col, text_col)
        fresh = index.add(part, str(place)).withColumn("seq", F.lit(place))
        part = part.withColumn("seq", F.lit(place))
        slim, new = (part, fresh) if slim is None else (slim.unionByName(part), new.unionByName(fresh))
    return judged(slim, index.totals(slim), new)


def deduplicated(docs: DataFrame, index: DigestIndex, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Where ids are unique only dropped ids meet the texts."""
    judged_ = verdicts(docs, index, batch, id_col, text_col)
    key, sha = common.fresh(docs, "exact_dedup_id", "exact_dedup_sha")
    if _unique(docs, id_col):
        gone = common.written(judged_.where("NOT kept").select(F.col("doc_id").alias(key)), "dropped")
        return docs.join(common.maybe_broadcast(gone), F.col(id_col).cast("long").eqNullSafe(F.col(key)), "left_anti")
    other = common.fresh(docs.withColumn(sha, F.lit("")), "exact_dedup_kept_sha")[0]
    kept = common.written(judged_.where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(other)), "kept")
    out = common.bound_batches(docs).withColumn(sha, F.lower(F.hex(text_digest(F.col(text_col)))))
    out = out.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(sha) == F.col(other)), "left_semi")
    return out.dropDuplicates([id_col, sha]).drop(sha)


def _unique(docs: DataFrame, id_col: str) -> bool:
    return docs.groupBy(id_col).count().where("count > 1").isEmpty()


def fresh_index(spark: SparkSession, buckets: int | None = None, docs: DataFrame | None = None) -> DigestIndex:
    """A new index in the shared folder; without ``buckets`` as many as the rows of ``docs`` ask for, eight at least."""
    if buckets is None and docs is not None:
        buckets = max(8, -(-docs.count() // BUCKET_TEXTS))
    return DigestIndex(spark, common.new_path(spark, "digest-index"), buckets)
