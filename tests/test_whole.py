"""Queries over all that their tables hold."""

import re

from lodestack.functions import text
from lodestack.operators import docs
from lodestack.plans import QUERIES
from lodestack.plans import texts as texts_plan


def by_hand(question):
    """Whole words rewritten outside protected values; a value's neighbours are no whole words."""
    clean = re.sub(r"\s+", " ", question).strip()
    fixed = [m.span() for m in re.finditer("|".join(text.PROTECTED), clean, re.I)]
    cuts = [0, *(x for s in fixed for x in s), len(clean)]
    out = ""
    for i in range(len(cuts) - 1):
        part = clean[cuts[i] : cuts[i + 1]]
        if i % 2:
            out += part
            continue
        part = "Z9" * (i > 0) + part + "Z9" * (i < len(cuts) - 2)
        for table, kept in ((text.ABBREVIATIONS, text.KEPT_ABBREVIATIONS), (text.SYNONYMS, ()), (text.TYPOS, ())):
            for key in sorted(table, key=len, reverse=True):
                if key in kept:
                    part = re.sub(rf"(?<!\()(?<!\w){re.escape(key)}(?!\w)(?!\s*\()", f"{table[key]} ({key.upper()})", part, flags=re.I)
                else:
                    part = re.sub(rf"(?<!\w){re.escape(key)}(?!\w)", table[key], part, flags=re.I)
        out += part[2 * (i > 0) : len(part) - 2 * (i < len(cuts) - 2)]
    return re.sub(r"\s+", " ", out).strip()


FREE = [
    "When does  hk1 begin,\n and where do I file the đkhp form?", "mã SV B1234567 của CNTT (KHMT) học kì 2", "2024-2025 sv, 12/3/2024hk K50 hp CT101", "TC tc tcx xtc ĐĂN KÝ môn học", "no rule holds here: 100 %",
    "Số 123/QĐ-ĐHCT, sinh vien khoá 48 đăng kí hoc phan", "", "  ",
]


def test_every_question_is_normalised(spark, tmp_path):
    rows = [(c, (9 - 8 * c) % 10, "user", t) for c, t in enumerate(FREE)] + [(0, t, "user", "unused") for t in range(9)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.normalised for r in QUERIES["query_normalise"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and set(got) == {(c, t) for c, t, *_ in rows}
    free = {(c, t): x for c, t, _, x in rows if (c * 8 + t) % 10 == 9}
    assert len(free) == len(FREE)
    assert {k: got[k] for k in free} == {k: by_hand(f"user: {x}") for k, x in free.items()}


def test_articles_of_every_regulation(spark, tmp_path):
    keys = [(7, 4), (7, 9), (7, 11), (8, 8), (10, 12), (10, 13)]
    spark.createDataFrame(keys, "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.doc_id, r.article): r.context for r in QUERIES["article_context"](spark, str(tmp_path)).collect()}
    sep = "\n\n---\n\n"
    assert got == {(7, "5"): f"title 4{sep}clause 9 text 11", (8, "9"): "title 8", (10, "13"): f"title 12{sep}clause 13"}


GRAMMARS = [
    (r"\s*(\d+(?:\.\d+)+)\.?\s+.+", lambda s: s, 0), (r"\s*(\d+)\.\s+.+", lambda s: s, 0), (r"\s*([IVXLCDM]+)\.\s+.+", str.upper, re.I),
    (r"\s*BƯỚC\s+(\d+)\s*[.：:\-–—]?\s*.*", lambda s: f"Bước {s}", re.I), (r"\s*ĐIỀU\s+(\d+[A-ZĐ]?)\s*[.)：:]?\s*.*", lambda s: f"Điều {s}", re.I),
]


def heads_by_hand(doc_id, text):
    """(pos, symbol, level, parent, section id, line) of a document's headings, (pos, None, ..., line) of its other lines."""
    out, seen = [], {}
    for pos, line in enumerate(text.split("\n")):
        a, b, c = pos % 9 + 1, pos % 4 + 1, pos % 3 + 1
        line = [f"{a}. {line}", f"{a}.{b} {line}", f"{a}.{b}.{c}. {line}", line, f"II. {line}"][(doc_id + pos * 3) % 5]
        hits = [(name(m[1]), len(m[1].split(".")) if k == 0 else 1) for k, (p, name, flag) in enumerate(GRAMMARS) if (m := re.fullmatch(p, line, re.S | flag))]
        if not hits:
            out.append((pos, None, None, None, None, line))
            continue
        symbol, level = hits[0]
        seen[symbol] = seen.get(symbol, 0) + 1
        parent = max((p for p, s, n, *_ in out if s and n < level), default=None)
        out.append((pos, symbol, level, parent, symbol if seen[symbol] == 1 else f"{symbol}_{seen[symbol]}", line))
    return out


NUMBERED = "\n".join(["1. Scope", "2.3 Terms of use", "", "4 apples", "2.3.1. Deeper still", "  7. Indented", "   ", "Điều 5. Articles", "2024 was a year", "plain text", "10.2 Last", "- 3. a bullet"])


def test_numbered_lines_are_headings(spark, tmp_path):
    texts = {i: NUMBERED for i in range(5)} | {5: "", 6: "3. alone", 8: "9.1 alone", 3: NUMBERED}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: heads_by_hand(i, t) for i, t in texts.items()}
    heads = {(i, *h) for i, hs in want.items() for h in hs if h[1]}
    at = str(tmp_path)
    assert {tuple(r) for r in QUERIES["section_levels"](spark, at).select("doc_id", "pos", "symbol", "level", "parent").collect()} == {h[:5] for h in heads}
    assert {tuple(r) for r in QUERIES["unique_suffix"](spark, at).select("doc_id", "pos", "section_id").collect()} == {(h[0], h[1], h[5]) for h in heads}
    got = {}
    for r in docs.section_trees(texts_plan._headed(spark, at), "doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).extend([r.title, *r.text.split("\n")])
    for i, hs in want.items():
        lines = [h[5].strip() for h in hs if h[5].strip()]
        assert sorted(x for x in got.get(i, []) if x) == sorted(lines)
