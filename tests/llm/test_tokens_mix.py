"""Tokens, packing, counts and mixing: exact round trips, and limits that must hold."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestack.llm import mixing, packing, token_counts, tokenizing

TEXTS = [
    "Hello, World!", "", None, "  don't  we'll 12½ ²a ", "İSTANBUL ΑΣ x", "<|endoftext|> hi", "e\u0301 a\u0301b", "日本語 テスト", "a\x1cb", "\u00a0a b\x85c", "don't…—x",
    "naïve ñandú ßtraße", "word " * 5000, " ".join(f"tok{i}" for i in range(3000)), "x" * 20_000,
]
SCHEMA = "doc_id long, text string, source string, size long, length long, sequence_id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 1, 1) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokenizing.default_path())


def test_batch_tokenizer_is_exact(plain, monkeypatch):
    for cached in (tokenizing.CACHED_WORDS, 50):
        monkeypatch.setattr(tokenizing, "CACHED_WORDS", cached)
        mine = tokenizing.BatchTokenizer(tokenizing.default_path())
        for part in (TEXTS, TEXTS[::-1], [], [None]):
            flat, starts = mine.encode(pa.array(part, pa.string()))
            assert [flat[a:b].tolist() for a, b in zip(starts, starts[1:])] == [plain.encode(t or "", add_special_tokens=False).ids for t in part]


def test_packing(spark, plain):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS * 3)] + [(None, "no id", "s")]
    got = packing.packed(docs(spark, rows), tokenizing.default_path(), window=512, with_ids=True).toPandas()
    want = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows if i is not None}
    for i, pieces in got.dropna(subset="doc_id").groupby("doc_id"):
        pieces = pieces.sort_values("start")
        assert [x for ids in pieces.ids for x in ids] == want[i]
        assert pieces.start.tolist() == [0, *np.cumsum(pieces.length)[:-1]] and set(pieces.doc_tokens) == {len(want[i])}
        assert pieces.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in pieces.ids]
    assert set(got.doc_id.dropna()) == set(want) and got.doc_id.isna().any()
    for _, pieces in got.groupby("sequence_id"):
        pieces = pieces.sort_values("offset")
        assert pieces.offset.tolist() == [0, *np.cumsum(pieces.length)[:-1]] and (n := pieces.length.sum()) <= 512 and n & (n - 1) == 0
    assert packing.packed(docs(spark, []), tokenizing.default_path()).count() == 0


def test_levels_choose_the_least_sum_of_squares():
    rng = np.random.default_rng(5)
    levels = packing.Levels(16)
    for size in rng.integers(1, 16, 400):
        def after(h):
            n = levels.count.copy()
            n[h] -= h > 0
            n[h + size] += h + size < 16
            return int((n[1:] ** 2).sum())

        could = [h for h in range(0, 17 - size) if h == 0 or levels.count[h]]
        chosen = levels.choose(int(size))
        assert after(chosen) == min(map(after, could))
        levels.place((0, 0, int(size), np.zeros(size, np.uint32)))
        assert levels.count.sum() == sum(map(len, levels.open.values()))


def test_token_counts(spark, plain):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS * 2)]
    n = [len(plain.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    hist = token_counts.histogram(token_counts.lengths(docs(spark, rows), tokenizing.default_path()))
    got = {r.context_limit: r for r in token_counts.limits(hist).collect()}
    assert set(got) == set(n)
    for limit, r in got.items():
        assert (r.docs_at_least, r.tokens_at_least, r.kept_tokens) == (sum(x >= limit for x in n), sum(x for x in n if x >= limit), sum(min(x, limit) for x in n))
        assert r.lost_tokens == sum(n) - r.kept_tokens and abs(r.share_below - sum(x < limit for x in n) / len(n)) < 1e-9 and abs(r.share_upto - sum(x <= limit for x in n) / len(n)) < 1e-9
    asked = {r.context_limit: r for r in token_counts.limits(hist, (1, 777, 1 << 40)).collect()}
    assert set(asked) == {*n, 1, 777, 1 << 40}
    for limit in (1, 777, 1 << 40):
        assert (asked[limit].n_docs, asked[limit].docs_at_least, asked[limit].kept_tokens) == (n.count(limit), sum(x >= limit for x in n), sum(min(x, limit) for x in n))
    q = {r.share: r.n_tokens for r in token_counts.quantiles(hist, [0.0, 0.5, 1.0]).collect()}
    assert q == {0.0: min(n), 0.5: sorted(n)[len(n) // 2 - 1], 1.0: max(n)}
    empty = token_counts.histogram(token_counts.lengths(docs(spark, []), tokenizing.default_path()))
    assert token_counts.limits(empty).count() == 0 and token_counts.limits(empty, (5,)).first()["share_upto"] is None


def shares(sizes):
    """Targets by resharing the excess until none is above; sizes by source, in order."""
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > 3 * sizes[s]}
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left, free = left - sum(3 * sizes[s] for s in over), free - over
    return target


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = [(i, "w " * (i % 9), None if i % 11 == 0 else "big") for i in range(400)] + [(1000 + i, "x y z", "tiny") for i in range(5)] + [(2000, None, "none"), (2001, "", "none"), (3000, "a " * 50_000, "whale"), (7, "w " * 7, "big")]
    got = mixing.takes(docs(spark, rows)).collect()
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ["big", "none", "tiny", "whale", None]}
    want = shares(size)
    assert len(got) == len(rows)
    seen = {}
    for r, s in ((r, next(x[2] for x in rows if x[0] == r.doc_id)) for r in got):
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        seen[s] = seen.get(s, 0) + r.taken
    for s, largest in (("big", 16), ("none", 0), ("tiny", 3), ("whale", 50_000), (None, 9)):
        assert abs(seen[s] - want[s]) <= largest / 2 + 1e-6
    assert sorted(got) == sorted(mixing.takes(docs(spark, rows).repartition(7)).collect())
    mix = mixing.mixed(docs(spark, rows))
    assert mix.columns == ["doc_id", "text", "source", "size", "length", "sequence_id"]
    assert sum(len((r.text or "").split()) for r in mix.collect()) == sum(seen.values())
    assert mixing.takes(docs(spark, [])).count() == 0
