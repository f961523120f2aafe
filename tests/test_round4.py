"""Cases of the fourth round's findings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions import vector
from lodestack.plans import ORACLES, QUERIES, answers
from lodestack.sources import shared

ROWS = "grp string, label string, id string, table_id string, v long"
ASKED = "query_id string, grp string, embedding array<double>"


def cosine(a, b):
    return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)


def best_of_tables(rows, values, grp, label, a, blank=None):
    """{table or id: (-score, id, table)} of a query's group and label."""
    best = {}
    for g, lab, i, t, v in rows:
        b = values.get(v)
        if (g, lab) != (grp, label):
            continue
        plain = not b or not any(b)
        if (plain and blank is None) or (not plain and (len(b) != len(a) or not any(a))):
            continue
        key = ("t", t) if t is not None else ("i", i)
        best[key] = min(best.get(key, (9, "", None)), (-(blank if plain else cosine(a, b)), i, t))
    return best


def test_results_of_questions_times_tables_are_dealt_by_their_pairs(spark):
    rng = np.random.default_rng(4)
    values = {i: rng.normal(size=4).tolist() for i in range(40)} | {40: [0.0] * 4, 41: [1.0, 2.0], 42: None}
    names = [*range(43), None]
    rows = [("g", "row", f"r{i:04}", f"t{i % 170}", names[i * 7 % 44]) for i in range(400)] + [("g", "row", f"w{i:04}", "wide", names[i * 5 % 44]) for i in range(300)] + [("h", "row", "x", "t1", None), ("i", "row", "y", "t1", 3)]
    asked = [(f"q{i}", "g", values[i % 20]) for i in range(60)] + [("zero", "g", [0.0] * 4), ("none", "g", None), ("short", "g", [2.0, 1.0]), ("blank", "h", [1.0, 0.0])]
    stored = shared.written(vector.numbered_vectors(spark.createDataFrame(list(values.items()), "v long, embedding array<double>")), "stored")
    q, at = spark.createDataFrame(asked, ASKED), spark.createDataFrame(rows, ROWS).withColumn("notice_id", F.concat(F.lit("n"), "table_id"))
    for blank in (0.0, None):
        # no table is as large as to be merged, or the wide one is
        for per_block, pairs in ((50, 1000), (1, 1000)):
            found = vector.scored_tables(q, at, stored, blank, ["notice_id"], per_block, pairs).withColumn("p", F.spark_partition_id()).collect()
            want = {(name, "row", i, t, f"n{t}", -s) for name, grp, a in asked if a for s, i, t in best_of_tables(rows, values, grp, "row", a, blank).values()}
            assert len(found) == len(want) and {(r.query_id, r.label, r.id, r.table_id, r.notice_id, r.score) for r in found} == want
            sizes = np.unique([r.p for r in found], return_counts=True)[1]
            assert per_block == 1 or max(sizes) < len(found) / 2  # all of a group was one task's before


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_against_all_pairs_where_single_precision_does_not_tell(spark, monkeypatch, k):
    kept, write = {}, shared.written
    monkeypatch.setattr(shared, "written", lambda df, label: kept.setdefault(label, write(df, label)))
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    # hardly apart; again under other names; far; of one wide table that has all of the nearest
    values = {i: (base + 1e-5 * rng.normal(size=8)).tolist() for i in range(60)} | {60 + i: rng.normal(size=8).tolist() for i in range(300)} | {360: [0.0] * 8, 361: [1.0, 1.0]}
    values |= {400 + i: values[i] for i in range(60)}
    names = sorted(values)
    rows = [("g", "row", f"r{i:04}", "wide" if v < 60 or v > 399 else f"t{v % 90}", v) for i, v in enumerate(names * 2)] + [("g", "section", f"s{i:04}", None, v) for i, v in enumerate(names)] + [("h", "row", f"x{i}", f"t{i % 2}", v) for i, v in enumerate(names)]
    asked = [(f"q{i}", "gh"[i % 2], (base + 1e-5 * rng.normal(size=8)).tolist() if i % 3 else rng.normal(size=8).tolist()) for i in range(24)] + [("again", "g", values[70]), ("same", "g", values[70]), ("zero", "g", [0.0] * 8)]
    stored = write(vector.numbered_vectors(spark.createDataFrame(list(values.items()), "v long, embedding array<double>")), "stored")
    q, at = spark.createDataFrame(asked, ASKED), spark.createDataFrame(rows, ROWS)
    for per_block in ((16_384, 32_768), (5, 70)):
        kept.clear()
        found = {(r.query_id, r.label, r.id, r.table_id, r.score) for r in vector.searched_within(q, at, k, per_block, stored).collect()}
        want = {(name, label, i, t, -s) for name, grp, a in asked if any(a) for label in ("row", "section") for s, i, t in sorted(best_of_tables(rows, values, grp, label, a).values())[:k]}
        assert {r[:4] for r in found} == {r[:4] for r in want} and found == want
        # vectors are multiplied once, whatever their names and however many rows they have
        assert kept["searched-rows"].where("grp = 'g' AND label = 'row'").count() == 361


def test_vectors_are_neither_copied_to_rows_nor_broadcast(spark):
    data = "/root/testdata/sf0.001"
    stored, asked = answers.model(spark, data), answers.asked(spark, data)
    assert "embedding" not in stored.rows.columns + stored.sections.columns and set(stored.vectors.columns) == {"v", "embedding"}
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (stored.rows, stored.sections, asked):
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


@pytest.mark.parametrize("name", ["lexed_items", "document_sections"])
def test_documents_of_short_and_blank_lines_agree_with_sql(spark, tmp_path, name):
    import duckdb

    rng = np.random.default_rng(6)
    words = ["An.", "sac", "LISTE", "CH 1", "", "", "...", "—", "an", "D", "XI.", "9", "the", "- ", "straße", "\xa0", "a\r", " x", " \x85"]
    lines = lambda n: "\n".join(" ".join(rng.choice(words, rng.integers(0, 4))) + " " * int(rng.integers(0, 3)) for _ in range(n))
    docs = spark.createDataFrame([(i, lines(int(rng.choice([1, 12, 90, 160])))) for i in range(120)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r)) for r in QUERIES[name](spark, str(tmp_path)).select(*names).collect())
