"""Every query of the catalogue against its SQL at the smallest size; the contract of the entry module."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lodestack.plans import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(plain(tuple(r)) for r in df.select(*names).collect()) == Counter(plain(r) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.columns and df.count() >= 0
    if name == "accent_search":
        import unicodedata

        plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if not unicodedata.combining(c))
        texts = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
        assert {r.doc_id for r in df.collect()} == {i for i, t in texts.items() if "elements" in t or "des ee" in t}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(QUERIES) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = lambda name: QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), EqualTo(l_quantity,50.0)" in plan("siblings_same_table")
    scan = plan("dedupe_ids")
    assert "l_extendedprice" not in scan and "l_orderkey" in scan
    assert "Cartesian" not in "".join(plan(n) for n in ("exact_cell_filter", "keyword_seeds", "bbox_antijoin", "router_rules"))


def test_nothing_else_imports_the_llm_subpackage():
    root = Path(__file__).resolve().parents[1]
    others = [p for p in [*(root / "lodestack").rglob("*.py"), *(root / "tests").glob("*.py"), root / "bench.py"] if "llm" not in p.relative_to(root).parts and p.name != "test_catalog.py"]
    assert others and not any("lodestack.llm" in p.read_text() for p in others)
    assert os.path.exists(root / "__spark_entry__.py")
