"""Exact, near and line dedup against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import hashlib
import itertools
import re
from collections import Counter

import pytest
import xxhash

from lodestack.llm import exact_dedup, line_dedup, mixing, simhash_dedup

SCHEMA = "doc_id long, text string, keep_id long, text_sha256 string, kept string"
WORDS = [f"w{i}" for i in range(40)]


def docs(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, 7, "s", "x") for i, t in texts], schema)


def some():
    base = " ".join(WORDS[i % 37] for i in range(200))
    return [
        (1, "Hello World again"), (2, "hello world again"), (3, "HELLO world AGAIN"), (4, None), (5, ""), (6, " \n\t"), (7, "É é"), (8, "é é"),
        (9, base), (10, base.replace("w3 ", "zz ", 1)), (11, base + " more"), (12, base.upper()), (13, "one"), (13, "one"), (None, "one"), (14, "a b c d " * 30_000),
    ]


def test_exact_dedup(spark):
    rows = some()
    got = exact_dedup.verdicts(docs(spark, rows), exact_dedup.fresh_index(spark, 4)).collect()
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    want = Counter((i, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    left = exact_dedup.deduplicated(docs(spark, rows), exact_dedup.fresh_index(spark, 4))
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in kept) and left.columns == ["doc_id", "text", "keep_id", "text_sha256", "kept"]


def test_exact_dedup_across_batches(spark):
    index = exact_dedup.fresh_index(spark, 4)
    run = lambda rows, batch, index=index: {r.doc_id: (r.kept, r.keep_id, r.group_size) for r in exact_dedup.verdicts(docs(spark, rows), index, batch).collect()}
    assert run([(1, "a"), (2, "b")], "x") == {1: (True, 1, 1), 2: (True, 2, 1)}
    spark.sql(f"DROP TABLE {index.table}")  # a new session's catalogue does not know the table
    again = exact_dedup.DigestIndex(spark, index.path)  # opened a second time, with the buckets it has
    assert again.buckets == 4
    want = {3: (False, 1, 2), 4: (True, 4, 1)}
    assert run([(3, "A"), (4, "c")], "y", again) == want and run([(3, "A"), (4, "c")], "y", again) == want  # a batch that runs again
    assert run([(5, "c"), (6, "a"), (7, "d"), (8, "D")], "z", again) == {5: (False, 4, 2), 6: (False, 1, 3), 7: (False, 8, 2), 8: (True, 8, 2)}
    assert run([(3, "A"), (4, "c")], "y", again) == {3: (False, 1, 3), 4: (True, 4, 2)}  # sizes count all batches so far
    again.compact()
    spark.sql(f"DROP TABLE {index.table}")
    third = exact_dedup.DigestIndex(spark, index.path, 4)
    assert third.rows().count() == 4 and run([(9, "d"), (10, "e")], "w", third) == {9: (False, 8, 3), 10: (True, 10, 1)}
    assert exact_dedup.verdicts(docs(spark, []), index, "v").count() == 0
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, index.path, 8)


def test_exact_dedup_reruns_with_fewer_texts(spark):
    index = exact_dedup.fresh_index(spark, 4)
    run = lambda rows, batch: {r.doc_id: (r.kept, r.keep_id, r.group_size) for r in exact_dedup.verdicts(docs(spark, rows), index, batch).collect()}
    assert run([(1, "t"), (2, "u")], "it's 1") == {1: (True, 1, 1), 2: (True, 2, 1)}
    assert run([(5, "T"), (6, "v")], "2") == {5: (False, 1, 2), 6: (True, 6, 1)}
    assert run([(2, "u")], "it's 1") == {2: (True, 2, 1)}  # without t: its copy in the second batch is now the first
    assert run([(9, "t")], "3") == {9: (False, 5, 2)}
    assert run([(5, "T"), (6, "v")], "2") == {5: (True, 5, 2), 6: (True, 6, 1)}
    assert run([], "it's 1") == {} and {r.batch for r in index.rows().collect()} == {"2", "3"}
    again = exact_dedup.DigestIndex(spark, index.path)
    assert {r.batch for r in again.rows().collect()} == {"2", "3"}
    assert run([(1, "t"), (7, "v")], "it's 1") == {1: (True, 1, 3), 7: (True, 7, 2)}  # back in its place, before the others
    assert run([(5, "T"), (6, "v")], "2") == {5: (False, 1, 3), 6: (False, 7, 2)}


def test_clashing_names(spark):
    names = ("simhash_gone", "_gone", "fp", "rep", "n", "component_id", "exact_dedup_id", "digest", "seq", "own_id", "new_in", "nth", "_s", "_n", "mix_times", "epochs", "cut", "key", "size")
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names)
    rows = [(1, "a b c d", "s"), (2, "a b c d", "t"), (3, "x y z", "s"), (4, None, None)]
    odd = spark.createDataFrame([(*r, *names) for r in rows], schema)
    near = simhash_dedup.deduplicated(odd)
    assert near.columns == odd.columns and {r.doc_id for r in near.collect()} == {1, 3, 4} and near.first()["fp"] == "fp"
    assert simhash_dedup.classes(odd).count() == 4
    exact = exact_dedup.deduplicated(odd, exact_dedup.fresh_index(spark, 4))
    assert exact.columns == odd.columns and {r.doc_id for r in exact.collect()} == {2, 3, 4}
    mix = mixing.mixed(odd)
    assert mix.columns == odd.columns and {r["_n"] for r in mix.collect()} == {"_n"} and {r.doc_id for r in mix.collect()} <= {1, 2, 3, 4}
    assert Counter(r.doc_id for r in mix.collect()) == Counter({r.doc_id: r.taken // r["size"] for r in mixing.takes(odd).collect() if r.taken})


def test_exact_dedup_in_two_batches(spark, monkeypatch):
    rows = some()
    monkeypatch.setattr(exact_dedup.common, "hot_rows", lambda total: 2)
    one = exact_dedup.verdicts(docs(spark, rows), exact_dedup.fresh_index(spark, 4), "x").collect()
    assert Counter(exact_dedup.in_batches(docs(spark, rows), exact_dedup.fresh_index(spark, 4)).collect()) == Counter(one)
    assert exact_dedup.in_batches(docs(spark, []), exact_dedup.fresh_index(spark, 4)).count() == 0
    odd = spark.createDataFrame([(1, "a", "s", 2), (3, "a", "t", 4)], "doc_id long, text string, exact_dedup_sha string, exact_dedup_id long")
    left = exact_dedup.deduplicated(odd, exact_dedup.fresh_index(spark, 4)).collect()
    assert [tuple(r) for r in left] == [(3, "a", "t", 4)]


def by_hand(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(fps):
    """Smallest id reachable, by id; fps: pairs of id and fingerprint."""
    best = {i: i for i, _ in fps}
    for _ in fps:
        for (a, x), (b, y) in itertools.combinations(fps, 2):
            if (x ^ y).bit_count() <= 3:
                best[a] = best[b] = min(best[a], best[b])
    return best


def test_simhash_against_brute_force(spark):
    rows = [(i, t) for i, t in some() if i is not None]
    lone = simhash_dedup.classes(docs(spark, [*rows, (None, "one"), (None, "two of them")])).where("doc_id is null").collect()
    assert Counter((r.fingerprint, r.component_id) for r in lone) == {(f"{by_hand('one'):016x}", 13): 1, (f"{by_hand('two of them'):016x}", None): 1}
    got = simhash_dedup.classes(docs(spark, rows)).collect()
    fps = [(i, by_hand(t)) for i, t in rows]
    best = reachable(fps)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{f:016x}", best[i]) for i, f in fps)
    assert simhash_dedup.classes(docs(spark, [])).count() == 0
    left = simhash_dedup.deduplicated(docs(spark, rows))
    assert {r.doc_id for r in left.collect()} == {i for i in best if best[i] == i} and "text_sha256" in left.columns


def test_simhash_links_and_large_cells(spark, monkeypatch):
    """Points around two centres and chains between them, with cells dealt into blocks of four."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", 8)
    centre = 0x9E3779B97F4A7C15
    points = {centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a + 1, 64, 7)} | {0, 7, 63, 0xFF00, 2**64 - 1}
    fps = list(enumerate(sorted(points)))
    signed = [(i, f - 2**64 if f >> 63 else f) for i, f in fps]
    best = reachable(fps)
    for n in (6, 8, 10):
        found = simhash_dedup.components(simhash_dedup.links(spark.createDataFrame(signed, "rep long, fp long"), n))
        got = {r.node: r.component for r in found.collect()}
        assert {i: got.get(i, i) for i, _ in fps} == best
        assert sum(simhash_dedup.groups(n)) == 2**64 - 1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    got = {r.node: r.component for r in simhash_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 140)}
    assert simhash_dedup.components(spark.createDataFrame([], "u long, v long")).count() == 0


def near(a, b):
    """One word put in, left out or exchanged."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) == len(a) + 1 and a[i:] == b[i + 1 :]


def test_line_dedup_against_brute_force(spark):
    rows = [
        (1, "a b c d e f\n\nshort line\na b c d e f"), (2, "a b c d e g\nshort line\nshort lines"), (3, "x a b c d e f\nb c d e f\nf e d c b a"),
        (4, None), (5, ""), (6, "a  b\tc d e f"), (7, "q r s t u v w x y z\nq r s T u v w x y z\nq r s T u v w x Y z"), (8, " ".join(f"v{i}" for i in range(3000))),
        (9, " ".join(f"v{i}" for i in range(3000) if i != 1500)), (None, "a b c d e f"), (10, "aa aa aa aa aa aa\naa aa aa aa aa"),
        (11, " ".join(f"u{i % 90}" for i in range(400))), (12, " ".join(f"u{i % 90}" if i != 399 else "end" for i in range(400))), (13, " ".join(["new", *(f"u{i % 90}" for i in range(400))])), (14, "\r\n \n\t"), (15, "1 2 3 4\n1 2 3 5\n1 2 3 4 5\n 0 1\x0b2 3 4 5 "),
    ]
    lines = [(i, k, tuple(line.split())) for i, t in rows if i for k, line in enumerate((t or "").split("\n")) if line.split()]
    first, want = {}, {}
    for i, k, w in lines:
        if w in first:
            want[i, k] = False
        first.setdefault(w, (i, k))
    for w, at in first.items():
        if len(w) >= 5 and any(o < at and len(v) >= 5 and abs(len(v) - len(w)) < 2 and near(w, v) for v, o in first.items() if v != w):
            want[at] = True
    assert want[9, 0] and want[12, 0] and want[13, 0]
    got = {(r.doc_id, r.line_no): r.near for r in line_dedup.dropped(docs(spark, rows)).collect()}
    assert got == want
    verdicts = {r.doc_id: r for r in line_dedup.verdicts(docs(spark, rows)).collect()}
    assert set(verdicts) == {i for i, _ in rows if i} and verdicts[1].dropped == [3] and verdicts[1].n_lines == 3
    left = {r.doc_id: r.text for r in line_dedup.deduplicated(docs(spark, rows)).collect()}
    assert left[1] == "a b c d e f\n\nshort line" and left[4] is None and left[6] == ""
    assert line_dedup.verdicts(docs(spark, [])).count() == 0


def test_lines_of_hot_groups_repeated_ids_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.common, "hot_rows", lambda total: 5)
    rows = [(i, f"one very common line\nline of its own {i} {i} {i} {i}x") for i in range(20)] + [(3, "one very common line\nother words of a row that repeats")] * 2
    got = {r.doc_id: r for r in line_dedup.verdicts(docs(spark, rows)).collect()}
    assert len(got) == 20 and got[0].dropped == [] and all(0 in got[i].dropped for i in range(1, 20)) and got[3].n_lines == 6
    odd = spark.createDataFrame([(1, "a\na", 5, "k"), (2, "a", 6, "l"), (None, "a", 7, "m")], "doc_id long, text string, line_dedup_id long, line_dedup_gone string")
    left = line_dedup.deduplicated(odd)
    assert left.columns == odd.columns and sorted((r.line_dedup_id, r.text) for r in left.collect()) == [(5, "a"), (6, ""), (7, "a")]


def test_one_template_and_one_long_document(spark):
    each = 1000
    rows = [(d, "\n".join(f"Page {d * each + i} of this report by us" for i in range(each))) for d in range(100)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.n_near) for r in line_dedup.verdicts(docs(spark, rows)).collect()}
    assert got == {0: (each, each - 1, each - 1)} | {d: (each, each, each) for d in range(1, 100)}
    log = [(1, "\n".join(f"{i // 2} records were read from {i} files" for i in range(60_000)))]
    r = line_dedup.verdicts(docs(spark, log)).first()
    assert (r.n_lines, r.n_dropped) == (60_000, 30_000) and r.dropped[:4] == [1, 3, 5, 7]
    left = line_dedup.deduplicated(docs(spark, log)).first().text.split("\n")
    assert len(left) == 30_000 and left[:2] == ["0 records were read from 0 files", "1 records were read from 2 files"]


def test_one_edit(spark):
    words = [tuple(x) for n in range(0, 4) for x in itertools.product("ab", repeat=n)]
    both = spark.createDataFrame([(list(a), list(b)) for a in words for b in words], "a array<string>, b array<string>")
    for r in both.select("a", "b", line_dedup.one_edit(line_dedup.F.col("a"), line_dedup.F.col("b")).alias("ok")).collect():
        assert r.ok == near(tuple(r.a), tuple(r.b)), (r.a, r.b)
