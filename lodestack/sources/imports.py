"""Imports into a store of tables: checked over all files first, staged, and committed by one rename.

A store is a folder of commits. A commit holds, as tables, what one import brought, the keys that it replaced or deleted,
and its report; it is written beside the store's commits and renamed into place, so that readers see all of it or none.
Reading takes for each key the rows of the last commit that wrote it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.sources.shared import BROADCAST_BYTES, spread, written

#: Names of a commit's own tables.
GONE, REPORT = "_replaced", "_report"
#: Hashes of ids, or names of failed files, that are broadcast at most.
BROADCAST_HASHES = 1_000_000
#: Words of 64 buckets of hashes, which are broadcast whatever the input, and ids of an import up to which these tell most stored ids apart.
WORDS, FEW_IDS = 1 << 20, 4_000_000
#: Hashes that a task groups.
HASHES_A_TASK = 2_000_000


class Store:
    """``tables`` names the store's tables and the column of each that says which key (file, notice, document) a row belongs to."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        """Numbers of the commits: as many names as there were imports since the last ``compact``."""
        path, fs = self._at("")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("commit="))

    def _all(self, name: str) -> DataFrame | None:
        paths = [f"{self.path}/commit={n}/{name}" for n in self.commits()]
        paths = [p for p in paths if self._at(p.removeprefix(f"{self.path}/"))[1].exists(self.spark._jvm.org.apache.hadoop.fs.Path(p))]
        if not paths:
            return None
        at = self.spark.read.option("basePath", self.path).option("mergeSchema", "true").parquet(*paths)
        return at.withColumn("commit", F.col("commit").cast("long"))

    def read(self, name: str, narrowed=None) -> DataFrame | None:
        """A table's rows, each key's from the last commit that wrote or deleted it; None before the first import. ``narrowed`` leaves
        out, before that, rows that are not wanted."""
        rows, gone = self._all(name), self._all(GONE)
        if rows is None:
            return None
        last = gone.groupBy("key").agg(F.max("commit").alias("last"))
        key = self.tables[name]
        rows = spread(rows, [key], rows.count()) if narrowed is None else narrowed(rows)
        at = rows.join(last, rows[key].cast("string") == last["key"], "left").where(F.col("last").isNull() | (F.col("commit") >= F.col("last")))
        return at.drop("key", "last", "commit")

    def report(self) -> DataFrame | None:
        """(file, status, error, counts, commit) of all imports."""
        return self._all(REPORT)

    def commit(self, parts: dict[str, DataFrame], gone: DataFrame, report: DataFrame, number: int | None = None) -> int:
        """Stages the tables and renames them into place as one commit. A commit of that number that is there is left, as a batch
        of a stream that runs again has been imported; two that race for a number end in an error for the later."""
        there = self.commits()
        number = number if number is not None else (there[-1] + 1 if there else 0)
        if number in there:
            return number
        staged = f"_staged-{uuid.uuid4().hex}"
        for name, df in {**parts, GONE: gone.select(F.col("key").cast("string").alias("key")), REPORT: report}.items():
            df.write.parquet(f"{self.path}/{staged}/{name}")
        source, fs = self._at(staged)
        target, _ = self._at(f"commit={number}")
        if fs.exists(target) or not fs.rename(source, target):
            raise RuntimeError(f"commit {number} is there already")
        return number

    def clean(self) -> int:
        """Removes what ended imports have staged; not to be called while one runs."""
        path, fs = self._at("")
        left = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("_staged-")]
        for p in left:
            fs.delete(p, True)
        return len(left)


def checked(files: DataFrame, ids: DataFrame, stored: DataFrame | None, replace: bool = False) -> DataFrame:
    """Files (file, key) with status and error: an import only inserts, and fails where an id of ``ids (file, id)`` is twice in the
    file, in two files that come at once, or in the store; so it does for a key that is there, unless it is to be replaced.

    ``stored`` has (id, key) of the store. With ``replace`` a file may bring ids again that its own key has. Of two files
    with one key both fail.
    """
    twice = ids.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
    own = ids.select("file", "id").distinct().join(twice.where("n > 1"), "id")
    faults = own.select("file", F.when(F.col("files") > 1, 2).otherwise(1).alias("fault"), F.col("id").cast("string").alias("what"))
    same = files.withColumn("_n", F.count("*").over(Window.partitionBy("key"))).where("_n > 1").select("file", F.lit(3).alias("fault"), F.col("key").cast("string").alias("what"))
    faults = faults.unionByName(same)
    if stored is not None:
        hit = ids.select("file", "id").distinct().join(stored.select("id", F.col("key").alias("stored_key")), "id").join(files.select("file", "key"), "file")
        if replace:
            hit = hit.where(F.col("stored_key") != F.col("key"))
        faults = faults.unionByName(hit.select("file", F.lit(4).alias("fault"), F.col("id").cast("string").alias("what")))
    first = faults.groupBy("file").agg(F.min(F.struct("fault", "what")).alias("f"))
    said = F.element_at(F.array(*map(F.lit, ("id twice in the file: ", "id in two files: ", "key of two files: ", "id is stored: "))), F.col("f.fault"))
    at = files.join(first, "file", "left")
    return at.select("file", "key", F.when(F.col("f").isNull(), "imported").otherwise("failed").alias("status"), F.concat(said, F.col("f.what")).alias("error"))


def _hash() -> Column:
    return F.xxhash64(F.col("id").cast("string"))


def _word(h: Column) -> tuple[Column, Column]:
    """A hash's word and its bit there."""
    return F.pmod(F.shiftright(h, 6), F.lit(WORDS)), h.bitwiseAND(63).cast("int")


def words(hashes: DataFrame) -> DataFrame:
    """(w, bits): the buckets that ``hashes (h)`` fall into, ``WORDS`` rows at most."""
    w, bit = _word(F.col("h"))
    at = hashes.select(w.alias("w"), bit.alias("bit")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    return written(at, "import-words")


def _like(df: DataFrame, some: DataFrame, h: Column) -> DataFrame:
    """Rows of ``df`` whose hash falls into a bucket of ``some``: all that are meant, and a share of others."""
    w, bit = _word(h)
    return df.join(F.broadcast(some), (w == some["w"]) & (F.getbit(some["bits"], bit) == 1), "left_semi")


def suspects(store: Store, ids: DataFrame) -> DataFrame:
    """(h): hashes of ``ids (file, id)`` that come twice or that a commit has had. Only these ids can be at fault, so that only
    hashes of all others are shuffled; ids that share a hash by chance are checked like any other. Of a large store a small import
    shuffles only the hashes that fall into its own buckets."""
    at, rows = ids.select(_hash().alias("h"), F.lit(1).cast("long").alias("n")), ids.count()
    stored = [(old.select(_hash().alias("h"), F.lit(None).cast("long").alias("n")), old.count()) for old in map(store._all, store.tables) if old is not None]
    own = words(at) if stored and rows <= FEW_IDS else None
    for old, n in stored:
        # a sixteenth of the buckets at most are taken
        at, rows = at.unionByName(old if own is None else _like(old, own, F.col("h"))), rows + (n if own is None else n // 16)
    found = spread(at, ["h"], rows, HASHES_A_TASK).groupBy("h").agg(F.count("n").alias("n"), F.count("*").alias("every"))
    return written(found.where("n > 1 or (n = 1 and every > 1)").select("h"), "import-hashes")


def _narrowing(hashes: DataFrame):
    """Leaves of rows with an ``id`` those whose hash is one of the written ``hashes``; of many, their buckets first, so that few rows are shuffled."""
    if hashes.count() <= BROADCAST_HASHES:
        return lambda df: df.join(F.broadcast(hashes), _hash() == hashes["h"], "left_semi")
    some = words(hashes)
    return lambda df: _like(df, some, _hash()).join(hashes.hint("merge"), _hash() == hashes["h"], "left_semi")


def imported(store: Store, parts: dict[str, DataFrame], files: DataFrame, replace: bool = False, number: int | None = None) -> DataFrame:
    """Imports the files that pass ``checked()`` as one commit and returns its report: (file, key, status, error, and the rows of each
    table). ``parts`` are the store's tables of all files, each with ``file`` and ``id``; ``files`` is (file, key).

    With ``replace`` a file's key is taken out and put in again at once. Nothing of a failed file gets in.
    """
    ids = reduce(DataFrame.unionByName, (df.select("file", "id") for df in parts.values()))
    narrowed = _narrowing(suspects(store, ids))
    ids = written(narrowed(ids), "import-ids")
    stored = None
    for name, key in store.tables.items():
        rows = store.read(name, narrowed)
        if rows is not None:
            rows = rows.select("id", F.col(key).cast("string").alias("key"))
            stored = rows if stored is None else stored.unionByName(rows)
    report = checked(files.withColumn("key", F.col("key").cast("string")), ids, stored, replace)
    n = reduce(DataFrame.unionByName, (df.select("file", F.lit(name).alias("part")) for name, df in parts.items()))
    n = n.groupBy("file").agg(*(F.count_if(F.col("part") == name).alias(name) for name in parts))
    tallies = written(report.join(n, "file", "full"), "import-tallies")
    # rows of a file that is not in ``files`` are not imported either
    out = tallies.where("file is not null and (status is null or status <> 'imported')").select("file")
    size = out.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.col("file").cast("string"))), F.lit(0)).alias("size")).first()
    few = size["n"] <= BROADCAST_HASHES and size["size"] <= BROADCAST_BYTES
    of = tallies.agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in parts)).first()
    kept = {}
    for name, df in parts.items():
        # many names are dealt, not the rows: a semi- or anti-join is pushed below a repartition, which would then shuffle them again
        gone = F.broadcast(out) if few else spread(out, ["file"], of[name]).hint("merge")
        kept[name] = df.where("file is not null").join(gone, "file", "left_anti")
    done = F.col("status") == "imported"
    counts = tallies.where("status is not null").select("file", "key", "status", "error", *(F.when(done, F.coalesce(name, F.lit(0).cast("long"))).otherwise(0).alias(name) for name in parts))
    store.commit({name: df.drop("file") for name, df in kept.items()}, counts.where(done).select("key"), counts, number)
    return counts


def streamed(store: Store, stream: DataFrame, split, checkpoint: str, replace: bool = True):
    """Starts a run over a stream of files: each micro-batch goes through ``split(df) -> (parts, files)`` and is one commit under its
    number, so that a batch that runs again after a loss is imported once."""

    def run(df: DataFrame, batch: int) -> None:
        parts, files = split(df)
        imported(store, parts, files, replace, batch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deleted(store: Store, keys: DataFrame) -> DataFrame:
    """Deletes all rows of ``keys (key)`` as one commit; (key, rows of each table that went)."""
    at = keys.select(F.col("key").cast("string").alias("key")).distinct()
    for name, key in store.tables.items():
        rows = store.read(name)
        n = F.lit(0).cast("long")
        if rows is not None:
            at = at.join(rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias(name)), "key", "left")
            n = F.coalesce(name, F.lit(0).cast("long"))
        at = at.withColumn(name, n)
    at = written(at, "deleted")
    report = at.select(F.lit(None).cast("string").alias("file"), "key", F.lit("deleted").alias("status"), F.lit(None).cast("string").alias("error"), *store.tables)
    store.commit({}, at.select("key"), report)
    return at
