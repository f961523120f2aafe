"""Transcripts: exact paths whatever the blocks, held-out accuracy. Archives: revisits of every kind, and files."""

import gzip
import itertools
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import chat_format, warc

DATA = "/root/testdata/sf0.01/conversations.parquet"


def test_best_paths_of_runs_side_by_side():
    """Paths of several runs against all paths there are, whole and through matrices of blocks."""
    rng = np.random.default_rng(3)
    k = len(chat_format.ROLES)
    model = {"start": rng.normal(size=k), "move": rng.normal(size=(k, k)), "stay": rng.normal(size=(k, k)), "emit": rng.normal(size=(k, chat_format.CODES))}
    edges = np.array([0, 7, 8, 13, 20])
    codes, begins = rng.integers(0, chat_format.CODES, 20), rng.integers(0, 2, 20)
    begins[edges[:-1]] = 2

    def score(path, at):
        total = 0.0
        for i, r in zip(at, path):
            total += (model["start"][r] if begins[i] == 2 else (model["move"] if begins[i] else model["stay"])[path[i - at[0] - 1], r]) + model["emit"][r, codes[i]]
        return total

    steps = chat_format.Steps(model, codes, begins, edges)
    got = steps.best(np.tile(model["start"], (4, 1)), np.full(4, -1))
    for a, b, m in zip(edges[:-1], edges[1:], steps.matrices()):
        best = max(itertools.product(range(k), repeat=b - a), key=lambda p: score(p, range(a, b)))
        assert tuple(got[a:b]) == best and abs(m.max() - score(best, range(a, b))) < 1e-9
    assert len(chat_format.Steps(model, codes[:0], begins[:0], np.array([0])).best(np.zeros((0, k)), np.zeros(0, int))) == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
def test_held_out_roles_and_blocks(spark, monkeypatch):
    every = spark.read.parquet(DATA)
    got = {(r.conv_id, r.turn): r for r in chat_format.held_out(every).collect()}
    want = {(r.conv_id, r.turn): r for r in every.collect()}
    texts = {(r.conv_id, r.turn): r.text for r in chat_format.transcribed(every).collect()}
    marked = {k for k in want if texts[k] != want[k].text}
    assert set(got) == set(want) and 0.4 < len(marked) / len(want) < 0.6
    right = {k for k in want if got[k].role == want[k].role}
    assert len(right & marked) / len(marked) > 0.97 and len(right - marked) / len(set(want) - marked) > 0.9
    for k, r in got.items():
        assert r.rendered.startswith(f"<|{r.role}|>\n") and r.rendered.endswith("\n<|end|>\n") and r.n_lines == len(want[k].text.split("\n"))
        assert k not in marked or r.role != want[k].role or "<|end|>\n<" in r.rendered or r.rendered == f"<|{r.role}|>\n{want[k].text}\n<|end|>\n"
    monkeypatch.setattr(chat_format, "BLOCK", 40)  # the same paths from many blocks
    assert {(r.conv_id, r.turn): r.rendered for r in chat_format.held_out(every).collect()} == {k: r.rendered for k, r in got.items()}


def test_odd_transcripts(spark, monkeypatch):
    rows = [(1, 0, "user", "Hi\nthere?"), (1, 1, "assistant", None), (None, None, "user", "x"), (1, 0, "user", "Hi\nthere?"), (2, 0, "poet", ""), (3, 0, "user", "Assistant: I know.\nUser: do you?")]
    rows += [(10 + i, t, ("user", "assistant")[t % 2], f"{('User', 'Bot')[t % 2]}: " * (i % 2) + "what is it ? " + "word " * (t % 2 * 30)) for i in range(20) for t in range(4)]
    at = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, rendered string, block int")
    model = chat_format.fitted(at.where("conv_id >= 10"))
    got = chat_format.formatted(at, model).collect()
    assert len(got) == len(rows)
    three = next(r for r in got if r.conv_id == 3)
    assert three.rendered == "<|assistant|>\nI know.\n<|end|>\n<|user|>\ndo you?\n<|end|>\n"
    assert chat_format.formatted(at.limit(0), model).count() == 0
    said = "User: how?\nplease\n\nBot: like this:\n- a\n- b"
    long = [(None, None, f"{'User' if i % 2 else 'Bot'}: line {i}") for i in range(300)] + [(8, 0, "\n".join(f"line {i}" if i % 1000 else f"{'User' if i % 2000 else 'Bot'}: {i}" for i in range(100_000)))]
    whole = spark.createDataFrame([(1, None, said), (2, None, None), *long], "conv_id long, turn long, text string")
    monkeypatch.setattr(chat_format, "BLOCK", 30_000)
    parsed = {(r.conv_id, r.rendered if r.conv_id is None else 0): r for r in chat_format.formatted(whole, model).collect()}
    assert len(parsed) == 303 and parsed[1, 0].rendered == "<|user|>\nhow?\nplease\n\n<|end|>\n<|assistant|>\nlike this:\n- a\n- b\n<|end|>\n"
    assert parsed[8, 0].n_lines == 100_000 and parsed[8, 0].rendered.count("<|user|>") == 50 and parsed[8, 0].rendered.count("<|assistant|>") == 50
    assert all((r.role == "user") == (int(r.rendered.split("line ")[1].split("\n")[0]) % 2 == 1) for k, r in parsed.items() if k[0] is None)


def test_revisits(spark):
    rows = [
        ("r1", "response", "http://www.A.org/x.html#top", 10, {"ETag": "1", "Content-Length": "5", "Age": "0"}), ("r2", "Response", "https://a.org:443/x/?utm_source=f", 20, {"etag": '"2"'}),
        ("v0", "revisit", "a://a.org/x", 5, {"a": "b"}), ("v1", "revisit", "http://a.org/x", 15, {"etag": "1", "Content-Length": "0", "AGE": "9"}), ("v2", "revisit", "http://a.org/x", 25, {"ETag": "1"}),
        ("v3", "revisit", "http://a.org/x", 20, {"ETag": 'W/1'}), ("v4", "revisit", "http://a.org/x", 99, None), ("v5", "revisit", None, 99, {}), ("v6", "revisit", "http://a.org/x", None, {}),
        ("v4", "revisit", "http://a.org/x", 99, None), ("m", "metadata", "http://a.org/x", 98, {}), ("q", "response", "http://a.org/x?b=1&ref=2", 97, {}), ("v7", "revisit", "http://a.org/x?ref=9&b=1", 98, {"last-modified": "d"}),
    ]
    at = spark.createDataFrame([(*r, bytearray(r[0].encode()), "s", 1) for r in rows], warc.RECORD + ", status string, range int")
    for partitions in (1, 7, None):
        got = {r.record_id: r for r in warc.resolved(at, partitions).collect()}
        assert {k: (r.response_id, r.status) for k, r in got.items()} == {
            "v0": (None, "missing"), "v1": ("r1", "resolved"), "v2": ("r2", "changed"), "v3": ("r1", "resolved"), "v4": ("r2", "unchecked"), "v5": (None, "missing"), "v6": (None, "missing"), "v7": ("q", "unchecked"),
        }
    assert got["v1"].headers == {"etag": "1", "content-length": "5", "age": "9"} and got["v0"].headers == {"a": "b"}
    assert warc.resolved(at).count() == 9 and warc.resolved(at.limit(0)).count() == 0
    bodies = {r.record_id: r.payload for r in warc.with_payloads(warc.resolved(at), at).collect()}
    assert bodies["v1"] == b"r1" and bodies["v2"] is None


def test_one_url_in_one_burst(spark):
    """All captures of one URL within one time or two, dealt into many ranges."""
    rows = [(f"r{i:04}", "response", "http://a.org/x", 5, {"etag": str(i)}) for i in range(500)] + [(f"v{i:04}", "revisit", "http://a.org/x", 5 + i % 2, {"etag": "499"}) for i in range(500)] + [("n", "revisit", None, None, None)] * 3
    at = spark.createDataFrame([(*r, None) for r in rows], warc.RECORD)
    got = warc.resolved(at, 16).collect()
    assert len(got) == 503
    for r in got:
        want = (None, "missing") if r.record_id == "n" or int(r.record_id[1:]) % 2 == 0 else ("r0499", "resolved")
        assert (r.response_id, r.status) == want


def test_malformed_records():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    bad = [good.replace(b"2024-01-02T03:04:05Z", b"yesterday"), good.replace(b"Length: 4", b"Length: many"), b"noise\r\n", good.replace(b"Content-Length: 4\r\n", b""), b"WARC/1.1", b"\xff\xfe"]
    for x in bad:
        got = list(warc.parse(x + b"\r\n" + good))
        assert got[-1][3] == 1704164645000000 and got[-1][5] == b"body"
    assert next(warc.parse(bad[0]))[3] is None
    whole = gzip.compress(good * 2000)
    assert len(list(warc.parse(whole))) == 2000 and len(list(warc.parse(whole[: len(whole) // 2]))) < 2000 and list(warc.parse(b"")) == []


def test_canonical_urls(spark):
    pairs = {"HTTP://Ex.ORG": "ex.org", "https://www.ex.org/a/": "ex.org/a", "http://ex.org/a?utm_medium=x&b=1&ref=y": "ex.org/a?b=1", "http://ex.org/A.html?q=1": "ex.org/A?q=1", "no scheme": "no scheme", "": ""}
    got = spark.createDataFrame([(k, v) for k, v in pairs.items()], "u string, v string").select("u", "v", warc.canonical_url(F.col("u")).alias("c")).collect()
    assert all(r.c == r.v for r in got)


def test_files(spark, tmp_path):
    def record(kind, uri, head, body):
        block = head + b"\r\n\r\n" + body
        return b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\nWARC-Target-URI: %s\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nContent-Length: %d\r\n\r\n" % (kind, kind, uri, len(block)) + block + b"\r\n\r\n"

    content = record(b"response", b"http://a/x", b"HTTP/1.1 200 OK\r\nETag: 1", b"WARC/1.0 body\r\n\r\n") + record(b"revisit", b"http://a/x", b"HTTP/1.1 304 Not Modified", b"")
    (tmp_path / "a.warc").write_bytes(content)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(content))
    got = warc.read(spark, str(tmp_path)).collect()
    assert len(got) == 4 and [bytes(r.payload) for r in got if r.type == "response"] == [b"WARC/1.0 body\r\n\r\n"] * 2
    assert got[0].headers == {"etag": "1"} and got[0].captured == 1704164645000000


def test_large_files_are_streams(spark, tmp_path):
    """A file larger than what a task may hold as a value: many records, one after the other, in names with blanks."""
    body = b"x" * 100_000
    one = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: 100000\r\n\r\n" + body + b"\r\n\r\n"
    (tmp_path / "a b%20.warc").write_bytes(b"".join(one % i for i in range(300)))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(gzip.compress(one % i) for i in range(300, 330)) + gzip.compress(one % 400)[:-300])
    (tmp_path / "empty.warc").write_bytes(b"")
    seen = warc.read(spark, str(tmp_path))
    assert "content" not in seen._jdf.queryExecution().executedPlan().toString()
    got = seen.selectExpr("record_id", "length(payload) AS n").collect()
    assert sorted(int(r.record_id[1:-1]) for r in got) == list(range(330)) and {r.n for r in got} == {100_000}


def test_streams_are_read_record_by_record():
    import io

    class Counted(io.RawIOBase):
        taken = 0

        def readable(self):
            return True

        def readinto(self, into):
            self.taken += len(into)
            into[:] = (record * (len(into) // len(record) + 2))[(self.taken - len(into)) % len(record) :][: len(into)]
            return len(into)

    record = b"WARC/1.1\r\nContent-Length: 1000\r\n\r\n" + b"y" * 1000 + b"\r\n\r\n"
    endless = Counted()
    records = warc.parse(endless)
    assert all(len(next(records)[5]) == 1000 for _ in range(5000)) and endless.taken < 5000 * len(record) + (2 << 20)
