"""Imports: checks over all files, atomic commits, restarts; vectors by a function handed in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import embedding
from lodestack.sources import imports

TABLES = {"notices": "id", "rows": "notice_id"}


def batch(spark, files):
    """files: {file: (notice id, row ids)}"""
    notices = spark.createDataFrame([(f, n, f"title {f}") for f, (n, _) in files.items()], "file string, id string, title string")
    rows = spark.createDataFrame([(f, r, n) for f, (n, rs) in files.items() for r in rs], "file string, id string, notice_id string")
    return {"notices": notices, "rows": rows}, notices.select("file", F.col("id").alias("key"))


def ids(store, name):
    return sorted(r.id for r in store.read(name).collect())


def test_imports_are_atomic(spark, tmp_path, monkeypatch):
    store = imports.Store(spark, f"{tmp_path}/store", TABLES)
    assert store.read("notices") is None and store.commits() == []
    got = imports.imported(store, *batch(spark, {"a": ("A", ["A1", "A2"]), "b": ("B", ["B1", "B1"]), "c": ("C", ["X"]), "d": ("D", ["X"]), "e": ("E", [])}))
    status = {r.file: (r.status, r.error, r.notices, r.rows) for r in got.collect()}
    assert status == {"a": ("imported", None, 1, 2), "b": ("failed", "id twice in the file: B1", 0, 0), "c": ("failed", "id in two files: X", 0, 0), "d": ("failed", "id in two files: X", 0, 0), "e": ("imported", None, 1, 0)}
    assert ids(store, "notices") == ["A", "E"] and ids(store, "rows") == ["A1", "A2"]
    got = imports.imported(store, *batch(spark, {"f": ("A", ["A9"]), "g": ("G", ["A1"]), "h": ("H", ["H1"])}))
    assert {r.file: r.error for r in got.collect()} == {"f": "id is stored: A", "g": "id is stored: A1", "h": None}
    got = imports.imported(store, *batch(spark, {"a2": ("A", ["A2", "A3"]), "i": ("I", ["H1"])}), replace=True)
    assert {r.file: r.error for r in got.collect()} == {"a2": None, "i": "id is stored: H1"}
    assert ids(store, "rows") == ["A2", "A3", "H1"] and ids(store, "notices") == ["A", "E", "H"]
    # ended between staging and commit: nothing is seen, and the import can run again
    rename = imports.Store.commits
    monkeypatch.setattr(imports.Store, "_at", lambda self, name, at=imports.Store._at: (_ for _ in ()).throw(KeyboardInterrupt()) if name.startswith("commit=3") else at(self, name))
    with pytest.raises(KeyboardInterrupt):
        imports.imported(store, *batch(spark, {"j": ("J", ["J1"])}))
    monkeypatch.undo()
    assert rename(store) == [0, 1, 2] and ids(store, "notices") == ["A", "E", "H"] and store.clean() == 1
    imports.imported(store, *batch(spark, {"j": ("J", ["J1"])}), number=3)
    imports.imported(store, *batch(spark, {"j": ("J", ["J1"])}), replace=True, number=3)  # the same batch of a stream, once more
    assert store.commits() == [0, 1, 2, 3] and ids(store, "notices") == ["A", "E", "H", "J"]
    gone = imports.deleted(store, spark.createDataFrame([("A",), ("Z",)], "key string"))
    assert {tuple(r) for r in gone.collect()} == {("A", 1, 2), ("Z", 0, 0)} and ids(store, "rows") == ["H1", "J1"]
    imports.imported(store, *batch(spark, {"k": ("A", ["A1"])}))
    assert ids(store, "rows") == ["A1", "H1", "J1"] and store.report().where("status = 'failed'").count() == 6


def test_streams_import_each_file_once(spark, tmp_path):
    store = imports.Store(spark, f"{tmp_path}/store", TABLES)
    spark.createDataFrame([("a", "A", ["A1", "A2"])], "file string, id string, rows array<string>").coalesce(1).write.json(f"{tmp_path}/in/1")

    def split(df):
        df = df.select("file", "id", "rows")
        return {"notices": df.select("file", "id", F.lit("t").alias("title")), "rows": df.select("file", F.explode("rows").alias("r"), F.col("id").alias("notice_id")).select("file", F.col("r").alias("id"), "notice_id")}, df.select("file", F.col("id").alias("key"))

    def run():
        stream = spark.readStream.schema("file string, id string, rows array<string>").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
        imports.streamed(store, stream, split, f"{tmp_path}/checkpoint").awaitTermination()

    run()
    run()
    assert ids(store, "rows") == ["A1", "A2"]
    spark.createDataFrame([("a", "A", ["A3"]), ("b", "B", ["B1"])], "file string, id string, rows array<string>").coalesce(1).write.json(f"{tmp_path}/in/2")
    run()
    assert ids(store, "rows") == ["A3", "B1"] and {r.file: r.commit for r in store.report().where("status = 'imported'").collect()} in ({"a": 0, "b": 1}, {"a": 1, "b": 1})


def test_vectors_for_what_has_none(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "one two"), ("b", "  "), ("c", "three"), ("d", None), ("e", "x" * 100_000), ("c", "three")], "id string, text string")
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return np.array([[len(t), t.count(" ") + 1, 0] for t in texts])

    path = f"{tmp_path}/vectors"
    assert {r.id for r in embedding.missing(nodes, embedding.vectors(spark, path)).collect()} == {"a", "c", "e"}
    first = embedding.embedded(embedding.missing(nodes.where("id = 'a'")), embed, 3)
    first.write.parquet(path)  # a run that was ended after its first step
    got = {r.id: r.embedding for r in embedding.embed_into(nodes, path, embed, 3, steps=4).collect()}
    assert set(got) == {"a", "c", "e"} and all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in got.values())
    assert got["a"] == pytest.approx([7 / 53**0.5, 2 / 53**0.5, 0]) and calls.value == 3
    assert {r.id for r in embedding.missing(nodes, embedding.vectors(spark, path), force=True).collect()} == {"a", "c", "e"}
    report = embedding.coverage(nodes.dropDuplicates(["id"]).withColumn("label", F.lit("n")), embedding.vectors(spark, path), "label").first()
    assert (report.n, report.with_text, report.embedded, report.sizes) == (5, 3, 3, 1)
    for bad in (lambda t: np.zeros((len(t), 3)), lambda t: np.ones((len(t), 2)), lambda t: np.full((len(t), 3), np.nan)):
        with pytest.raises(Exception, match="embedder"):
            embedding.embedded(nodes.where("id = 'a'"), bad, 3).collect()


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_only_ids_that_may_be_at_fault_are_compared(spark, tmp_path, monkeypatch, most):
    kept, write = {}, imports.written
    monkeypatch.setattr(imports, "written", lambda df, label: kept.setdefault((label, len(kept)), write(df, label)))
    monkeypatch.setattr(imports, "BROADCAST_HASHES", most)
    compared = lambda: sorted(str(r.id) for (label, _), df in kept.items() if label == "import-ids" for r in df.collect())
    store = imports.Store(spark, f"{tmp_path}/store", TABLES)
    got = imports.imported(store, *batch(spark, {**{f"f{i}": (f"N{i}", [f"r{i}.{j}" for j in range(5)]) for i in range(20)}, "x": ("X", ["twice", "twice", None, None]), "y": ("Y", ["r3.1"])}))
    status = {r.file: (r.error, r.notices, r.rows) for r in got.collect()}
    assert status == {**{f"f{i}": (None, 1, 5) for i in range(20) if i != 3}, "f3": ("id in two files: r3.1", 0, 0), "y": ("id in two files: r3.1", 0, 0), "x": ("id twice in the file: twice", 0, 0)}
    assert set(compared()) <= {"r3.1", "twice", "None"} and len(store.read("rows").collect()) == 95
    kept.clear()
    got = imports.imported(store, *batch(spark, {"f1": ("N1", ["r1.0", "new"]), "z": ("Z", ["r2.0", "fresh"]), "x": ("X", ["twice"])}), replace=True)
    assert {r.file: r.error for r in got.collect()} == {"f1": None, "z": "id is stored: r2.0", "x": None} and compared() == ["N1", "r1.0", "r2.0"]
    assert ids(store, "rows")[-3:] == ["r9.3", "r9.4", "twice"] and len(store.read("rows").collect()) == 93


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_rows_are_shuffled_once_at_most(spark, tmp_path, monkeypatch, most):
    plans, spread, session = [], imports.spread, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(imports, "BROADCAST_HASHES", most)
    monkeypatch.setattr(imports, "spread", lambda df, keys, rows, *_: spread(df, keys, rows, 2))  # as for more rows than the session's partitions take
    commit = imports.Store.commit

    def planned(self, parts, *a):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for more files than are broadcast
        plans.append(parts["rows"].select("*")._jdf.queryExecution().executedPlan().toString())
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", session)
        return commit(self, parts, *a)

    monkeypatch.setattr(imports.Store, "commit", planned)
    store = imports.Store(spark, f"{tmp_path}/store", TABLES)
    first, files = batch(spark, {**{f"f{i}": (f"N{i}", [f"r{i}.{j}" for j in range(5)]) for i in range(40)}, "x": ("X", ["r3.1"])})
    of_files = [(f"f{i}", f"r{i}.{j}", f"N{i}") for i in range(40) for j in range(5)]
    first["rows"] = spark.createDataFrame([*of_files, ("x", "r3.1", "X"), ("unknown", "u1", "U"), (None, "u2", "U")], "file string, id string, notice_id string")
    got = imports.imported(store, first, files)
    assert {r.file: r.rows for r in got.collect()} == {**{f"f{i}": 5 for i in range(40) if i != 3}, "f3": 0, "x": 0}
    assert ids(store, "rows") == sorted(f"r{i}.{j}" for i in range(40) for j in range(5) if i != 3)
    monkeypatch.setattr(imports, "FEW_IDS", most, raising=False)
    got = imports.imported(store, *batch(spark, {"g": ("G", ["g1", "r7.2"]), "h": ("H", ["h1", "r3.1"]), "f9": ("N9", ["r9.0"])}), replace=True)
    assert {r.file: (r.error, r.rows) for r in got.collect()} == {"g": ("id is stored: r7.2", 0), "h": (None, 2), "f9": (None, 1)}
    assert ids(store, "rows") == sorted([*(f"r{i}.{j}" for i in range(40) for j in range(5) if i not in (3, 9)), "h1", "r3.1", "r9.0"])
    of_rows = [p.count("Exchange hashpartitioning(file") for p in plans]
    assert of_rows == ([0, 0] if most else [2, 2])  # two: that of the failed files' names and that of the rows
