"""The pipeline's stages against brute force, each on what the one before has kept; the queries against their SQL."""

import os
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodestack.llm import tokenizing
from lodestack.llm.queries import QUERIES
from lodestack.llm.sql import ORACLES

from .test_dedup import by_hand, reachable
from .test_rules_pii import figures
from .test_tokens_mix import shares

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("a", "e", "in", "ost", "ul", "arn", "eck")]
    rng, out = random.Random(8), []
    for i in range(60):
        body = " ".join(rng.choices(words, k=60 + i * 3))
        out.append((i, body, f"src{i % 4}" if i % 9 else None))
    out += [(100, out[3][1].upper(), "src1"), (101, out[5][1], "src0"), (102, out[7][1] + " tail", "src2"), (103, "short", "src0"), (104, None, "src0"), (105, "again and again " * 40, "src3"), (106, out[59][1].replace(words[0], "zzz", 1), "src3")]
    return out


def test_stages_against_brute_force(spark, tmp_path):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    kept = {i: (t, s) for i, t, s in rows}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [name for name, _ in corpus_pipeline.STAGES] and 4 <= len(stages) <= 5

    def step(name, docs):
        stages[name](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    def bad(t):
        n, _, _, _, repeat = figures(t)
        return n < 50 or 100 * repeat > 50 * n

    kept = {i: x for i, x in kept.items() if not bad(x[0])}
    docs = step("quality_rules", docs)
    assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and {r.doc_id for r in docs.collect()} == set(kept)
    best = {}
    for i, (t, _) in kept.items():
        best[t.lower()] = max(i, best.get(t.lower(), -1))
    kept = {i: kept[i] for i in best.values()}
    docs = step("exact_dedup", docs)
    assert {r.doc_id for r in docs.collect()} == set(kept) and 100 in kept and 3 not in kept
    first = reachable([(i, by_hand(t)) for i, (t, _) in kept.items()])
    kept = {i: x for i, x in kept.items() if first[i] == i}
    docs = step("simhash_near_dedup", docs)
    assert {r.doc_id for r in docs.collect()} == set(kept)
    sizes = Counter()
    for t, s in kept.values():
        sizes[s] += len(t.split())
    want = shares({s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))})
    docs = step("mixing", docs)
    taken = Counter()
    for r in docs.collect():
        taken[r.source] += len(r.text.split())
        assert kept[r.doc_id] == (r.text, r.source)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(len(t.split()) for t, x in kept.values() if x == s) / 2 + 1
    times = Counter(r.doc_id for r in docs.collect())
    plain = Tokenizer.from_file(tokenizing.default_path())
    pieces = step("packing", docs).toPandas()
    assert Counter(pieces.groupby("doc_id").length.sum().to_dict()) == Counter({i: n * (len(plain.encode(kept[i][0], add_special_tokens=False).ids) + 1) for i, n in times.items()})


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_queries_against_sql(spark):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, str(DATA))
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        fixed = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
        assert Counter(map(fixed, df.select(*names).collect())) == Counter(map(fixed, cur.fetchall())), name


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_other_queries_run(spark):
    os.environ.setdefault("TZ", "UTC")
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, str(DATA)).count() > 0, name
