"""Rendering, and runs in stages."""

import pytest
from pyspark.sql import functions as F

from lodestack.functions import render
from lodestack.plans import stages


def test_properties(spark):
    props = {"zeta": "z", "ten": " Tên ", "embedding": "[1]", "so": "", "path": "[]", "ma_nganh": "7"} | {f"k{i:02}": "v" for i in range(20)}
    r = spark.createDataFrame([(props,)], "p map<string,string>").select(render.useful_properties(F.col("p")).alias("u"), render.display_name(F.col("p"), F.lit("?")).alias("n")).first()
    assert r.u[:3] == ["ma_nganh: 7", "ten: Tên", "k00: v"] and len(r.u) == 12 and r.n == "Tên"


def test_scalars(spark):
    df = spark.createDataFrame([("so: {\"a\": 1} ok", "3,5", "9"), ("none", "x", "z"), (None, None, None)], "j string, n string, c string")
    got = df.select(render.salvaged_json(F.col("j"), "a int")["a"].alias("j"), render.number(F.col("n")).alias("n"), render.clamped(F.col("c"), 1, 5, 2).alias("c")).collect()
    assert [tuple(r) for r in got] == [(1, 3.5, 5), (None, 0.0, 2), (None, 0.0, 2)]
    one = spark.createDataFrame([(1, 2), (0, 0)], "a int, b int").select(render.percent(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in one] == ["1/2 = 50.0%", "N/A"]
    text = spark.createDataFrame([("abcdefgh",), ("abc",)], "t string").select(render.truncated(F.col("t"), 6).alias("t")).collect()
    assert [r.t for r in text] == ["abc...", "abc"]
    lines = spark.createDataFrame([("**1.2 Name**",), ("a **b** c",), ("# x",)], "t string").select(render.markdown_headers(F.col("t")).alias("t")).collect()
    assert [r.t for r in lines] == ["### 1.2 Name", "a b c", "# x"]
    items = spark.createDataFrame([("head\n- one\n  more\n+ two",), (None,)], "t string").select(render.bullets(F.col("t")).alias("t")).collect()
    assert [r.t for r in items] == [["one more", "two"], []]


def test_stages(spark, tmp_path):
    steps = [("double", lambda d: d.withColumn("v", F.col("v") * 2)), ("plus", lambda d: d.withColumn("v", F.col("v") + 1)), ("square", lambda d: d.withColumn("v", F.col("v") * F.col("v")))]
    src = spark.createDataFrame([(1,), (2,)], "v long")
    assert {r.v for r in stages.run(spark, src, steps, str(tmp_path)).collect()} == {9, 25}
    assert {r.v for r in stages.run(spark, src.limit(0), steps, str(tmp_path), "square").collect()} == {9, 25}
    with pytest.raises(ValueError):
        stages.run(spark, src, steps, str(tmp_path), "none")
    with pytest.raises(ValueError):
        stages.run(spark, src, steps, str(tmp_path), "square", "double")
    done = spark.createDataFrame([(2,)], "v long")
    assert [r.v for r in stages.pending(src, done, "v").collect()] == [1] and stages.pending(src, done, "v", [1, 2], 1).count() == 1
    with pytest.raises(ValueError):
        stages.pending(src, done, "v", [7])
