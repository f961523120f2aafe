"""Cases of the third round's findings."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions import render, vector
from lodestack.operators import curriculum, graph, ruled, tables
from lodestack.plans import QUERIES, notifications, programs
from lodestack.sources import shared


def test_decimals_are_rounded_by_the_exact_value(spark):
    scores = [0.4930385, 0.5047875, 0.4835115, 0.4732535, 0.1234565, 1.0, -0.0000005, 0.0000015, 1234.5678905]
    at = spark.createDataFrame([(x,) for x in scores], "x double")
    assert [r[0] for r in at.select(render.fixed(F.col("x"), 6)).collect()] == [f"{x:.6f}" for x in scores]
    hits = F.array(F.struct(F.col("x").alias("score"), F.array(F.lit("L")).alias("labels"), F.create_map(F.lit("id"), F.lit("1")).alias("props")))
    said = [r[0].split("score=")[1].split(" ")[0] for r in at.select(render.vector_lines(F.lit("t"), F.lit("i"), hits)).collect()]
    assert said == [f"{x:.6f}" for x in scores]
    shares = [(1, 16), (3, 16), (1, 3), (5, 0)]
    got = [r[0] for r in spark.createDataFrame(shares, "a long, b long").select(render.percent(F.col("a"), F.col("b"))).collect()]
    assert got == [f"{a}/{b} = {100 * a / b:.1f}%" if b else "N/A" for a, b in shares]


def test_rows_with_one_vector_meet_questions_once(spark, monkeypatch):
    kept, write = {}, shared.written
    monkeypatch.setattr(shared, "written", lambda df, label: kept.setdefault(label, write(df, label)))
    values = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [1.0, 1.0], [-1.0, 0.5]]
    rows = [("g", "row", f"r{i:03}", f"t{i // 3 % 40}", values[i % 5]) for i in range(240)] + [("g", "section", f"s{i:03}", None, values[i % 5]) for i in range(60)]
    rows += [("g", "row", "zero", "t1", [0.0, 0.0]), ("g", "row", "none", "t2", None), ("g", "row", "wide", "t3", [1.0, 0.0, 0.0]), ("h", "row", "other", "t0", [1.0, 0.0])]
    asked = [(f"q{i}", "g", [[1.0, 0.2], [0.1, 1.0]][i % 2]) for i in range(50)] + [("z", "g", [0.0, 0.0]), ("n", "g", None)]
    q = spark.createDataFrame(asked, "query_id string, grp string, embedding array<double>")
    at = spark.createDataFrame(rows, "grp string, label string, id string, table_id string, embedding array<double>")
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    for k in (3, None):
        kept.clear()
        got, want = sorted(tuple(r) for r in vector.searched_within(q, at, k).collect()), []
        for name, grp, a in asked[:50]:
            for label in ("row", "section"):
                best = {}
                for g, lab, i, t, b in rows:
                    if (g, lab) == (grp, label) and b and len(b) == len(a) and any(b):
                        best[t or i] = min(best.get(t or i, (9, "", None)), (-cos(a, b), i, t))
                want += [(name, label, i, t, -s) for s, i, t in sorted(best.values())[:k]]
        key = lambda r: (*r[:3], r[3] or "", r[4])
        assert sorted(got, key=key) == sorted(want, key=key)
        assert kept["asked-vectors"].count() == 2 and (k is None or kept["searched-rows"].where("label = 'row' and grp = 'g'").count() <= 3 * 7)


def test_exact_candidates_are_counted_without_being_made(spark):
    rows = [("a", "row", "1", "t1", None, 2), ("a", "row", "2", "t1", None, 2), ("a", "row", "3", "t2", None, None), ("a", "row", "4", "t3", None, 3), ("a", "row", "5", "t3", None, 2), ("b", "row", "1", "t1", None, 2)]
    at = spark.createDataFrame(rows, "grp string, label string, id string, table_id string, v binary, d int")
    asked = [(1, "a", True, [1.0, 0.0]), (2, "a", True, [1.0, 0.0, 0.0]), (3, "a", True, [0.0, 0.0]), (4, "a", True, None), (5, "b", True, [1.0, 0.0]), (6, "c", True, [1.0, 0.0]), (7, "a", False, [1.0, 0.0])]
    q = spark.createDataFrame(asked, "query_id long, ask_id string, is_exact boolean, query_vector array<double>")
    assert {tuple(r) for r in notifications.exact_counts(q, at).collect()} == {(1, 3), (2, 2), (3, 1), (5, 1), (6, 0)}


def test_a_join_with_large_results_is_dealt_out(spark):
    left = spark.range(3000).select("id", (F.col("id") % 3).alias("k"))
    right = spark.range(900).select((F.col("id") % 3).alias("k"), (F.col("id") * 10).alias("other")).unionByName(spark.createDataFrame([(None, 1), (7, 1)], "k long, other long"))
    at = shared.dealt_join(left, right, ["k"], pairs=50_000)
    assert at.columns == ["k", "id", "other"] and at.count() == 900_000 and at.distinct().count() == 900_000
    assert at.exceptAll(left.join(right, "k").select(*at.columns)).isEmpty()
    sizes = [r[0] for r in at.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 6 and max(sizes) < 300_000  # a key alone has 300,000
    assert shared.dealt_join(left, right.where("k = 7"), ["k"]).isEmpty()


def test_programs_in_scope_are_not_one_task(spark, monkeypatch):
    join = shared.dealt_join
    monkeypatch.setattr(curriculum, "dealt_join", lambda a, b, keys: join(a, b, keys, pairs=10_000))
    asked = spark.createDataFrame([(i, "50", " CLC") for i in range(1000)], "query_id long, cohort string, mode string")
    at = curriculum.of_programs(asked, spark.createDataFrame([(i, 50, "clc ") for i in range(200)], "id long, cohort int, mode string"))
    assert at.count() == 200_000 and at.groupBy(F.spark_partition_id()).count().count() > 4


def test_paths_do_not_meet_their_seeds_again(spark):
    edges = spark.createDataFrame([("hub", f"n{i}", "A") for i in range(50)], "src string, dst string, type string")
    seeds = spark.createDataFrame([("n1",), ("n2",), ("alone",)], "id string")
    got = graph.expanded(edges, seeds, 2)
    assert got.groupBy("seed", "depth").count().where("count > 0").collect() and {(r.seed, r.depth): r["count"] for r in got.groupBy("seed", "depth").count().collect()} == {("n1", 1): 1, ("n1", 2): 49, ("n2", 1): 1, ("n2", 2): 49, ("alone", 0): 1}
    assert "LeftOuter" not in got._jdf.queryExecution().toString()


def test_names_are_worked_out_once(spark):
    at = spark.createDataFrame([([" a", None, "a", "b ", "a", ""],), ([],), (None,)], "n array<string>")
    names = tables.unique_names(F.col("n"))
    assert [r[0] for r in at.select(names).collect()] == [["a", "cot_2", "a_2", "b", "a_3", "cot_6"], [], None]
    assert at.select(names)._jdf.queryExecution().analyzed().toString().count("cot_") <= 2  # once for each time the plan is said; it was thrice


def test_tasks_grow_in_number_with_the_rows(spark):
    at = spark.range(4000).select((F.col("id") % 500).alias("k"), "id")
    got = shared.spread(at, ["k"], 4000, 200)
    assert got.rdd.getNumPartitions() == 20 and got.count() == 4000 and got.select("k", F.spark_partition_id().alias("p")).distinct().count() == 500
    assert shared.spread(at, ["k"], 10).rdd.getNumPartitions() == 4


def test_ruled_tables_are_dealt_by_page_once(spark):
    words = [("p", 1, 10.0, 5.0, 20.0, 15.0, " a  b"), ("p", 1, 10.0, 5.0, 20.0, 15.0, " a  b"), ("p", 2, 60.0, 5.0, 70.0, 15.0, "c"), ("p", 0, 60.0, 25.0, 80.0, 35.0, "wide"), ("p", 3, 10.0, 105.0, 20.0, 115.0, "next"), ("p", 4, 500.0, 5.0, 510.0, 15.0, "out"), (None, 5, 10.0, 5.0, 20.0, 15.0, "x"), ("q", 6, 1.0, 1.0, 2.0, 2.0, "no lines")]
    up = [(0.0, 0.0, 40.0), (1.0, 0.0, 40.0), (50.0, 0.0, 20.0), (100.0, 0.0, 40.0), (0.0, 100.0, 120.0), (100.0, 100.0, 120.0)]
    lines = [(p, x, y0, x, y1) for p in ("p", None) for x, y0, y1 in up] + [(p, 0.0, y, 100.0, y + 1) for p in ("p", None) for y in (0.0, 1.5, 20.0, 40.0, 100.0, 120.0)]
    w = spark.createDataFrame(words, "page string, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    at = ruled.cells(w, spark.createDataFrame(lines, "page string, x0 double, y0 double, x1 double, y1 double"), ["page"])
    assert at._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # lines and words; it was every step
    assert sorted(tuple(r) for r in at.collect()) == [("p", 1, 0, ["a b", "c"]), ("p", 1, 1, ["wide", ""]), ("p", 2, 0, ["next"])]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no tables")
def test_pages_of_queries_stay_where_they_were_dealt(spark, monkeypatch):
    monkeypatch.setattr(programs, "ROWS_A_TASK", 500)
    at = QUERIES["ruled_cells"](spark, "/root/testdata/sf0.001")
    assert "Exchange hashpartitioning(page" in (plan := at._jdf.queryExecution().executedPlan().toString()) and "ENSURE_REQUIREMENTS" not in plan
    assert at.rdd.getNumPartitions() > 4
