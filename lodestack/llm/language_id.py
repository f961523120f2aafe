"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are runs of lower-cased letters with single blanks between them; each n-gram of one to three of these
characters is hashed into a bucket. Counts by language and bucket are sums over all labelled documents:
each task keeps one array, Spark adds the arrays' entries up. The matrix of log probabilities, of languages
times buckets, is broadcast, and a batch of texts is scored in numpy as sparse rows (starts, buckets) times
that matrix. Texts are read whole, long ones in stretches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm import common

#: Characters of an n-gram, and buckets that these are hashed into.
ORDERS, BUCKETS = (1, 2, 3), 1 << 16
#: Added to every count.
SMOOTHING = 0.5
#: Entries of the broadcast matrix, of 8 bytes each, at most: with these buckets 512 languages.
MOST_ENTRIES = 1 << 25
#: Characters in a stretch of a text, and entries of a slice of scores.
STRETCH, SLICE = 1 << 18, 1 << 20
UNKNOWN = "und"
#: One document in four is held out.
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; one without an id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@cache
def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter or a mark, else a blank."""
    plain = [0x20] * 0x110000
    for i in range(0x110000):
        if unicodedata.category(c := chr(i))[0] in "LM":
            low = c.lower()
            plain[i] = ord(low) if len(low) == 1 else i
    return np.array(plain, np.uint32)


def _stretches(text: str | None) -> Iterator[np.ndarray]:
    """The characters of a text as letters and single blanks, one blank at each end, in overlapping stretches."""
    codes = _letters()[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]
    codes = np.concatenate(([0x20], codes, [0x20])).astype(np.uint64)
    codes = codes[np.r_[True, (codes[1:] != 0x20) | (codes[:-1] != 0x20)]]
    if len(codes) < 3:
        return  # no letters
    step = STRETCH - max(ORDERS) + 1
    for i in range(0, max(1, len(codes) - max(ORDERS) + 1), step):
        yield codes[i : i + STRETCH]


def _buckets(codes: np.ndarray, last: bool) -> np.ndarray:
    """The buckets of a stretch's n-grams; those that begin in the next stretch too are left to it unless it is the ``last``."""
    begin = len(codes) if last else len(codes) - max(ORDERS) + 1
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(((mixed[:begin] >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(out)


def features(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, stretch by stretch; none if it has no letter."""
    before = None
    for codes in _stretches(text):
        if before is not None:
            yield _buckets(before, False)
        before = codes
    if before is not None:
        yield _buckets(before, True)


@dataclass(frozen=True)
class Model:
    """Languages in order, the logarithms of their shares of documents, and of their buckets' probabilities (buckets x languages)."""

    langs: list[str]
    prior: np.ndarray
    weights: np.ndarray


def counts(docs: DataFrame, langs: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n): how often each bucket occurs in the documents of each language, by its number in ``langs``."""
    number = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(number), BUCKETS), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for buckets in features(text):
                    sums[number[lang]] += np.bincount(buckets, minlength=BUCKETS)
        for i, row in enumerate(sums):
            there = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), i, np.int32)), pa.array(there.astype(np.int32)), pa.array(row[there])], names=["lang", "bucket", "n"])

    at = common.bound_batches(docs).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    return at.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all documents with a language that are not held out.

    The driver gets one row for each language and bucket, of which there are ``MOST_ENTRIES`` at most; more
    languages are an error.
    """
    learned = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull())
    shares = {r[0]: r[1] for r in learned.groupBy(F.col(lang_col).cast("string")).count().limit(MOST_ENTRIES // BUCKETS + 1).collect()}
    if len(shares) * BUCKETS > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES // BUCKETS} languages")
    langs = sorted(shares)
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    if langs:
        got = counts(learned, langs, text_col, lang_col).toArrow()
        table[got["lang"].to_numpy(), got["bucket"].to_numpy()] += got["n"].to_numpy()
    total = sum(shares.values())
    prior = np.log(np.array([shares[lang] / total for lang in langs]))
    return Model(langs, prior, np.ascontiguousarray(np.log(table / table.sum(axis=1, keepdims=True)).T))


def scores(model: Model, buckets: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Sums of the weights of sparse rows: row i has the buckets from starts[i] on; none of the rows is empty."""
    at = np.concatenate(buckets)
    return np.add.reduceat(model.weights[at], starts, axis=0)


def _scored(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Log scores (texts x languages) and whether a text has a letter."""
    out, lettered = np.tile(model.prior, (len(texts), 1)), np.zeros(len(texts), bool)
    rows: list[int] = []
    held: list[np.ndarray] = []
    size, most = 0, max(1, SLICE // max(1, len(model.langs)))

    def flush() -> None:
        if held:
            np.add.at(out, rows, scores(model, held, np.cumsum([0, *map(len, held[:-1])])))
            rows.clear()
            held.clear()

    for i, text in enumerate(texts):
        for all_ in features(text):
            lettered[i] = True
            for a in range(0, len(all_), most):
                part = all_[a : a + most]
                if size + len(part) > most:
                    flush()
                    size = 0
                rows.append(i)
                held.append(part)
                size += len(part)
    flush()
    return out, lettered


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score.

    The score is the language's posterior probability; of equal ones the first language in order is taken. A
    text that is null or has no letter, or a model that has learned nothing, gives ``und`` with score 0. A
    document without an id is predicted and learned from as any other that is not held out. Repeated rows are
    rows of their own; an empty table gives no rows; other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            if not model.langs:
                names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                logs, lettered = _scored(model, texts)
                top = logs.argmax(axis=1)
                best = np.where(lettered, 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                names = [model.langs[t] if ok else UNKNOWN for t, ok in zip(top, lettered)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(best)], names=["doc_id", "held_out", "lang_pred", "score"])

    at = common.bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return at.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``predicted()`` by the model ``fitted()`` to the same documents, but for those held out."""
    return predicted(docs, fitted(docs, id_col, text_col, lang_col), id_col, text_col)
