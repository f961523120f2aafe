"""Language identification against a naive Bayes by hand, and on documents held out."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from lodestack.llm import language_id
from lodestack.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, held_out string, score long, lang_pred int"
DATA = Path("/root/testdata/sf0.01")


def rows():
    out = []
    for i in range(120):
        out.append((i, ["the cat and the hat %d", "der hund und die katze %d", "le chat et la souris %d"][i % 3] % i + " x" * (i % 5), ["en", "de", "fr"][i % 3]))
    out += [(200, None, "en"), (201, "", "en"), (202, "12 34 !?", "de"), (203, "the hat", None), (204, "Das Und DIE", "xx"), (None, "le chat", "fr"), (None, "the cat", None)]
    return out + [(205, "the cat " * 60_000, "en"), (206, "й ц у", None), (7, out[7][1], out[7][2])]


def grams(text):
    letters = "".join(c.lower() if unicodedata.category(c)[0] in "LM" else " " for c in text or "")
    s = " " + " ".join(letters.split()) + " "
    return [s[i : i + n] for n in language_id.ORDERS for i in range(len(s) - n + 1)] if s.strip() else []


def by_hand(rows, bucket):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    learn = [(t, lang) for i, t, lang in rows if lang is not None and not out(i)]
    seen, docs = defaultdict(Counter), Counter(lang for _, lang in learn)
    for t, lang in learn:
        seen[lang].update(bucket(g) for g in grams(t))
    total = {lang: sum(seen[lang].values()) + language_id.SMOOTHING * language_id.BUCKETS for lang in docs}
    for i, t, _ in rows:
        found = Counter(bucket(g) for g in grams(t))
        if not found:
            yield i, out(i), "und", 0.0
            continue
        log = {lang: math.log(docs[lang] / len(learn)) + sum(n * math.log((seen[lang][g] + language_id.SMOOTHING) / total[lang]) for g, n in found.items()) for lang in sorted(docs)}
        best = max(sorted(log), key=log.get)
        yield i, out(i), best, 1 / sum(math.exp(x - log[best]) for x in log.values())


def one_bucket(gram):
    codes = np.array([ord(c) for c in gram], np.uint64)
    h = 0
    for n, c in enumerate(codes.tolist(), 1):
        h = (h * 0x9E3779B97F4A7C15 + c + n) % 2**64
    return ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64 >> 40) % language_id.BUCKETS


def test_against_brute_force(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "x", 5, 6) for r in rows()], SCHEMA).repartition(3)
    got = language_id.identified(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    want = Counter((i, o, lang, round(s, 6)) for i, o, lang, s in by_hand(rows(), one_bucket))
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in got.collect()) == want
    assert language_id.identified(df.limit(0)).count() == 0
    nothing = language_id.identified(df.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    monkeypatch.setattr(language_id, "MOST_ENTRIES", language_id.BUCKETS * 2)
    with pytest.raises(ValueError):
        language_id.fitted(df)


def test_stretches_leave_no_gram_out(monkeypatch):
    text = "Abc déf, ghi! " * 50
    whole = Counter(np.concatenate(list(language_id.features(text))).tolist())
    assert whole == Counter(map(one_bucket, grams(text)))
    for size in (3, 4, 7, 64, 600, 601, 602):
        monkeypatch.setattr(language_id, "STRETCH", size)
        assert Counter(np.concatenate(list(language_id.features(text))).tolist()) == whole
    assert not list(language_id.features(None)) and not list(language_id.features("1 2 ?"))


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_held_out_accuracy(spark):
    got = QUERIES["op12_language_id"](spark, str(DATA)).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and r.lang_pred != "und"]
    assert len(held) > 150 and sum(held) / len(held) > 0.97
