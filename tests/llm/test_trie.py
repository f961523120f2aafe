"""The prefix trie against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from lodestack.llm import prefix_trie
from lodestack.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
DATA = Path("/root/testdata/sf0.001")


def by_hand(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members, ending, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        ending[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = Counter(), Counter()
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1]) if node else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), len(children[n]), leaves[n], saved[n], sha(ending[n])) for n, who in members.items())


def got(df):
    return Counter(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def odd_rows():
    rows = [(c, t, "user" if t % 2 else "bot", f"turn {t} {c % 3 if t > 3 else ''}") for c in range(95, 130) for t in range(c % 7 + 1)]
    rows += [(c, t, "user", "the same") for c in range(200, 240) for t in range(4)]  # one sequence, many conversations
    rows += [(205, None, None, None), (206, 9, None, "x" * 5000), (None, 1, "user", "nobody's"), (207, 3, "user", "the same"), (207, 3, "user", "the same")]
    rows += [(300, t, "user", f"long {t % 5}") for t in range(150)] + [(301, t, "user", f"long {t % 5}") for t in range(149)]
    rows += [(-17, 0, "user", "below zero"), (450, 0, "user", "alone"), (550, 0, "user", "é" * 3), (10_000_000_000, 0, "user", "far")]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", depth int, k1 string").repartition(3)
    assert got(prefix_trie.trie(df)) == by_hand(rows)
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)  # many blocks of turns and of ids
    monkeypatch.setattr(prefix_trie.common, "hot_rows", lambda total: 2)
    assert got(prefix_trie.trie(df)) == by_hand(rows)
    assert prefix_trie.trie(df.limit(0)).count() == 0


def test_ranks_across_ranges(spark):
    rows = [(1, t, "user", "equal") for t in range(300)] + [(2, 5, "user", "equal")] * 40 + [(3, None, None, None)]
    turns = prefix_trie.ranked(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert Counter((r.c, r.r) for r in turns) == Counter([(1, i + 1) for i in range(300)] + [(2, i + 1) for i in range(40)] + [(3, 1)])


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op11_prefix_trie"](spark, str(DATA))) == by_hand(rows)
