"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lodestack.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, rank long, score string"


def by_hand(rows, longest, least, top, share):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, seen in f.items():
        often = {p: a for p, a in seen.items() if a >= least and " " in p}
        longer = Counter()
        for p, a in often.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    q = " ".join(w[i : i + k])
                    longer[q] = max(longer[q], a)
        found = []
        for p, a in often.items():
            if 100 * longer[p] >= share * a:
                continue
            w = p.split(" ")
            cuts = [(seen[" ".join(w[:j])], seen[" ".join(w[j:])]) for j in range(1, len(w))]
            score, j = min((2_000_000 * a // (x + y), j) for j, (x, y) in enumerate(cuts))
            found.append((-score, -a, p.encode(), cuts[j]))
        for i, (score, a, p, (x, y)) in enumerate(sorted(found)[:top], 1):
            out.append((lang, i, p.decode(), -a, x, y, total[lang], -score))
    return Counter(out)


def rows():
    rng, out = random.Random(3), []
    words = ["the", "of", "New", "York", "city", "é", "日本", "x-y", "a_b", "of'"]
    for i in range(150):
        body = " ".join(rng.choices(words, k=rng.randint(0, 40)))
        body += rng.choice(["", ". in the long run", ",In THE long\trun ", "\nonce upon a time;once upon", "  hot hot hot hot hot ", "!?"])
        out.append((body, ["en", "fr", None, "und"][i % 4]))
    return [*out, (None, "en"), ("", None), (" \t", "fr"), ("lone\x00word \x00", "en"), ("big time " * 30_000, "fr"), out[3], out[3]]


@pytest.mark.parametrize("longest, least, top, share, buckets", [(4, 3, 2000, 80, 1 << 12), (4, 5, 7, 80, 32), (3, 2, 20, 60, 64), (2, 3, 5, 80, 1 << 10), (5, 4, 50, 90, 1 << 16)])
def test_against_brute_force(spark, monkeypatch, longest, least, top, share, buckets):
    monkeypatch.setattr(collocations, "RANKED", 16)
    monkeypatch.setattr(collocations.common, "hot_rows", lambda total: 2)
    df = spark.createDataFrame([(i, t, lang, "x", 1, 2, "y") for i, (t, lang) in enumerate(rows())], SCHEMA).repartition(3)
    got = collocations.collocations(df, longest=longest, least=least, top=top, share=share, buckets=buckets)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert Counter(map(tuple, got.collect())) == by_hand(rows(), longest, least, top, share)


def test_nothing(spark):
    df = spark.createDataFrame([(1, "a b a b", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(df).count() == 0 and collocations.collocations(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        collocations.counted(df, buckets=100)


def test_exact_beyond_64_bits(spark):
    far = 6_000_000_000_000_000_001
    one = spark.createDataFrame([("en", "a", far), ("en", "b", far)], "lang string, phrase string, f long")
    two = spark.createDataFrame([("en", "a b", far - 1)], "lang string, phrase string, f long")
    assert collocations.scored([one, two]).first().score == 2_000_000 * (far - 1) // (2 * far)
    three = spark.createDataFrame([("en", "a b c", far * 4 // 5)], "lang string, phrase string, f long")
    assert collocations.absorbed([one, two, three]).count() == 1
    assert collocations.absorbed([one, two, three.selectExpr("lang", "phrase", "f - 1 as f")]).count() == 0
