"""Quality rules and personal data against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np

from lodestack.llm import pii, quality_rules

SCHEMA = "doc_id long, text string, source string, host string, n_words long, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "h", 1, "x") for i, t, s in rows], SCHEMA)


def figures(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", "  ", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n \nx ", "# é $ 😀 <b>|&*%", "one two three four " * 30, " ".join(f"w{i}" for i in range(80)),
    " ".join(f"w{i % 30}" for i in range(61)), "p q r s p q r t p q r", "\x0bodd\x0cspaces\u00a0stay\x85", "long tail " * 40_000,
]


def test_base_figures(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    for r in quality_rules.measured(docs(spark, rows)).collect():
        want = figures(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, TEXTS[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "too short"
    rows = [(i, bad, "junk") for i in range(60)] + [(100, good, "junk")] + [(200 + i, good, None) for i in range(60)] + [(300, bad, "tiny"), (301, good, "tiny")]
    got = {r.doc_id: r for r in quality_rules.judged(docs(spark, rows)).collect()}
    assert len(got) == len(rows) and not got[100].base_failed and not got[100].kept
    assert got[200].kept and got[301].kept and not got[300].kept
    left = quality_rules.filtered(docs(spark, rows))
    assert {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r.kept} and left.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert quality_rules.judged(docs(spark, [])).count() == 0


def shrunk(hosts):
    """Rates and probabilities by hand: variance between and within hosts, and beta integrals by a fine sum."""
    total, bad, k = sum(n for n, _ in hosts), sum(x for _, x in hosts), len(hosts)
    mean = bad / total
    between = sum(n * (x / n - mean) ** 2 for n, x in hosts) / (k - 1)
    within = sum(n * (x / n) * (1 - x / n) for n, x in hosts) / (total - k)
    size = (total - sum(n * n for n, _ in hosts) / total) / (k - 1)
    strength = min(1e6, max(1.0, 1 / ((between - within) / (between + (size - 1) * within)) - 1)) if between > within else 1e6
    odds = 4 * mean / (1 - mean)
    out = []
    u = np.linspace(-300, 300, 2_000_001)  # logits: the density has poles at rates of 0 and 1
    for n, f in hosts:
        a, b = f + mean * strength, n - f + (1 - mean) * strength
        d = a * u - (a + b) * np.logaddexp(0, u)
        d = np.exp(d - d.max())
        out.append((a / (a + b), d[u > np.log(odds)].sum() / d.sum()))
    return out


def test_host_rates(spark):
    for hosts in ([(50, 6)] * 5 + [(50, 30), (3, 3), (1, 1), (400, 30), (2000, 900)], [(50, 5), (60, 6), (70, 7)], [(1, 1), (1, 0), (30, 20), (40, 0)]):
        rows = [(f"h{i}", i + 10 * j < 10 * x + i) for i, (n, x) in enumerate(hosts) for j in range(n)]
        got = {r.host: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
        for i, ((n, x), (rate, p)) in enumerate(zip(hosts, shrunk(hosts))):
            r = got[f"h{i}"]
            assert (r.n, r.failed) == (n, x) and abs(r.rate - rate) < 1e-9 and abs(r.p_above - p) < 2e-3 and r.host_ok == (r.p_above < 0.95), (n, x, r, rate, p)
    rows = [("junk", True)] * 60 + [("one", True)] + [(f"s{i}", i % 10 == 0) for i in range(1000)]
    bad = {r.host for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).where("NOT host_ok").collect()}
    assert bad == {"junk"}  # many hosts of one document do not switch shrinking off
    for one in (True, False):
        assert all(r.host_ok for r in quality_rules.host_verdicts(spark.createDataFrame([("a", one), ("b", one)], "host string, base_failed boolean")).collect())


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def by_hand(text):
    out = [(m.start(), k, m.end()) for k, (name, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if passes(name, m[0])]
    return ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in sorted(out))


PRIVATE = [
    None, "", "mail a.b@x.org, or a@b.c_d@e.f.g!", "é😀 me@x.co 1.2.3.4 and 1.2.3.4.5.6.7.8", "999.1.1.1 0001.02.3.255 1.2.3", "card 4111 1111 1111 1111 x", "4111-1111-1111-1112",
    "+1 (555) 123-4567 then +44 20 7946 0958.", "+1 2", "++49 (0) 30 123456 -- 12", "a" * 50_000 + "@", "1" * 50_000, "9 " * 20_000, "x@y", "@a.b", "a@b.c@d.e", "%+-@q.r-s.t", "1.2.3.4@x.y 5500 0000 0000 0004",
    " ".join(f"u{i}@h.example" for i in range(3000)),
]


def test_base_spans(spark):
    rows = [(i, t, "s") for i, t in enumerate(PRIVATE)]
    got = pii.digests(pii.spans(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = by_hand(PRIVATE[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (PRIVATE[r.doc_id] or "")[:60]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in BASE]
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term")) == want
    assert pii.digests(pii.spans(docs(spark, []))).count() == 0


def test_disclosing_terms(spark):
    filler = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    rows = [(i, f"{filler} {'abcdefghijklmno'[i]}way reach Zorblax at zor@x.example today", "s") for i in range(-15, 0)] + [(9, "Zorblax was seen, reach him", "s"), (10, "zor@x.example", "s"), (None, "Zorblax", "s")]
    rows += [(20 + i, f"reach {filler} today", "s") for i in range(9)]
    assert {r.term for r in pii.disclosing_terms(docs(spark, rows)).collect()} == {"Zorblax"}
    got = {r.doc_id: r.spans for r in pii.digests(pii.spans(docs(spark, rows))).collect()}
    assert got[9] == "term:0:7" and got[10] == "email:0:13" and got[None] == "term:0:7" and got[-1].startswith("term:") and got[20] == ""
    clean = {r.doc_id: r.text for r in pii.sanitised(docs(spark, [*rows, (40, None, "s")])).collect()}
    label = pii.disclosing_terms(docs(spark, rows)).first()["general"]
    assert clean[9] == f"{label} was seen, reach him" and clean[None] == label and clean[10] == "[EMAIL]" and clean[-1].endswith(f"reach {label} at [EMAIL] today") and clean[20] == rows[18][1] and clean[40] is None
