"""Terms next to entities against plain Python: occurrences, contexts, disclosure and generalisation."""

import math
import re
from collections import Counter, defaultdict

from lodestack.llm import pii
from tests.llm.test_rules_pii import BASE, docs, passes

FILLER = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
TOKEN = re.compile("|".join(f"(?P<{k}>{BASE[k]})" for k in ("email", "phone", "ip", "card")) + r"|(?P<word>[^\W\d_]+)")


def tokens(text):
    for m in TOKEN.finditer(text):
        k = m.lastgroup if m.lastgroup else next(k for k, v in m.groupdict().items() if v)
        k = next(k for k in ("email", "phone", "ip", "card", "word") if m[k])
        if k == "word" or passes(k, m[0]):
            yield (None, m[0]) if k == "word" else (f"{k}:{m[0].lower()}", None)


def by_hand(texts):
    n, together, contexts, classes = Counter(), Counter(), defaultdict(set), Counter()
    cls = lambda t: "[WORD]" if t.upper() == t else "[Word]" if t[0].isupper() and t[1:].islower() else "[word]"
    for text in texts:
        seq = list(tokens(text))
        for i, (_, t) in enumerate(seq):
            if t and len(t) >= 4:
                n[t] += 1
                around = seq[max(i - 4, 0) : i + 5]
                for e in {e for e, _ in around if e}:
                    together[t, e] += 1
                    contexts[t, e].add(tuple((x, y if y and len(y) >= 4 else None) for x, y in around))
    total = sum(n.values())
    chance = Counter()
    for (t, e), c in together.items():
        chance[e] += c / total
        classes[cls(t), e] += c
    size = Counter()
    for t, c in n.items():
        size[cls(t)] += c
    share = lambda c, of, p: 1 - math.log2((c + p) / (of + 1)) / math.log2(p)
    out = {}
    for (t, e), c in together.items():
        d = share(c, n[t], chance[e])
        if len(contexts[t, e]) >= 3 and d >= 0.95:
            k = cls(t)
            out[t, e] = (c, n[t], len(contexts[t, e]), round(d, 9), k if share(classes[k, e], size[k], chance[e]) < 0.95 else "")
    return out


TEXTS = [
    *[f"{FILLER} {w} Zorblax Berg, since 2024, card 4111111111111111" for w in ("alpha", "gamma", "delta", "zeta", "iota", "kappa", "sigma")],
    *[f"smith smith@smith.org {w} smith" for w in ("reach", "mail", "call")], "smith@smith.org smith",
    *[f"Quux {w} 😀 a@x.example b@y.example Garply 10.20.30.40 11 22 33 Waldo, 1.2.3.4@z.example Plugh" for w in ("Corge", "Grault", "Fred")],
    *[f"ЖУКОВ {w} +44 20 7946 0958 ЖУКОВ +44 20 7946 0958" for w in ("один", "два", "три", "четыре")],
    "é" * 130 + " +1 (555) 123-4567 then +44 20 7946 0958.", "a@b.c@d.e 999.1.1.1 Fred", "", *[FILLER] * 5,
    *["Copied Person p.q@copies.example told"] * 9,
]


def test_terms_against_brute_force(spark):
    got = {(r.term, r.entity): (r.together, r.n, r.support, round(r.disclosure, 9), r.general) for r in pii.disclosing_terms(docs(spark, [(i, t, "s") for i, t in enumerate(TEXTS)])).collect()}
    assert got == by_hand(TEXTS)
    assert got["Zorblax", "card:4111111111111111"][:2] == (7, 7) and got["smith", "email:smith@smith.org"][:2] == (7, 7)
    assert got["ЖУКОВ", "phone:+44 20 7946 0958"][0] == 8  # between two hits of one number each occurrence counts once
    assert not any(t in ("Copied", "Person") for t, _ in got)  # one text, however often it is copied, is one context
    assert {g for *_, g in got.values()} >= {"[Word]", ""}
