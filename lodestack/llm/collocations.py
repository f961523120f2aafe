"""Phrases that words form more often than chance, language by language, counted by PCY / DHP hashing.

Pass k counts phrases of k words exactly and, on the way, phrases of k + 1 words by hashed buckets. Two
bitmaps of fixed size go to the next pass: the buckets that have enough, and the hashes of the phrases that
have enough. A phrase is counted in pass k only if its bucket and both of its parts of k - 1 words have
their bits (a bit that is set by another phrase costs work, not correctness). What was counted is then
joined with the counts of its parts. Each pass reads all texts as batches of codes in numpy; Spark adds up
what the batches have found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm import common

#: Words of a phrase, occurrences that it needs, and phrases that are returned for each language.
LONGEST, LEAST, TOP = 4, 30, 2000
#: A longer phrase with so many hundredths of a phrase's occurrences replaces it.
ABSORBED = 80
#: Score of a phrase whose words never occur without each other, times (l + r) / a.
SCALE = 2_000_000
#: Buckets of a bitmap: 1 MB, 8 MB as counts within a task. More buckets let fewer rare phrases through; results are the same.
BUCKETS = 1 << 23
#: Rows that one task ranks at most in one step.
RANKED = 1 << 16
_BREAK = "\n"
#: The bucket of a language's number of words.
TOTAL = -1


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)


def _coded(texts: pa.Array, langs: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, list[str]]:
    """The words of a batch as codes in order, -1 between pieces; the words; each one's language as a code; the languages."""
    low = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[.,;:!?\x0A-\x0D]+", f" {_BREAK} ")
    parts = pc.split_pattern_regex(low, r"[\x20\x09]+")
    sizes = np.diff(parts.offsets.to_numpy())
    words = parts.flatten().dictionary_encode()
    names = words.dictionary.to_pylist()
    at, doc = words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    there = np.array([x != "" for x in names], bool)
    at, doc = at[there[at]], doc[there[at]]
    at = np.where(np.array([x == _BREAK for x in names], bool)[at], -1, at)
    # a piece ends with its document
    ends = np.flatnonzero(np.diff(doc)) + 1
    at, doc = np.insert(at, ends, -1), np.insert(doc, ends, doc[ends - 1] if len(ends) else 0)
    lang = langs.dictionary_encode()
    return at, names, lang.indices.to_numpy()[doc].astype(np.int64), lang.dictionary.to_pylist()


def _bit(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bitmap[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class _Counter:
    """One task's share of a pass: phrases of k words batch by batch, buckets of those of k + 1 words at the end."""

    def __init__(self, k: int, items: np.ndarray | None, buckets: np.ndarray | None, longest: int, size: int):
        self.k, self.items, self.buckets, self.longest, self.size = k, items, buckets, longest, size
        self.sums = np.zeros(size if k < longest else 0, np.int64)

    def _hashes(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(self.size - 1)).astype(np.int64)

    def batch(self, texts: pa.Array, langs: pa.Array) -> Iterator[pa.RecordBatch]:
        at, names, lang, langs_ = _coded(texts, langs)
        k, n = self.k, len(at)
        word = np.array([_hash(x) for x in names] or [0], np.uint64)[at]
        own = np.array([_hash(x) for x in langs_] or [0], np.uint64)[lang]
        # h[j] hashes the j words from each place on, ok[j] says whether they are within one piece
        h, ok = [own, _mixed(own * np.uint64(31) + word)], [np.ones(n, bool), at >= 0]
        for j in range(2, k + 2):
            h.append(_mixed(h[-1][: n - j + 1] * np.uint64(31) + word[j - 1 :]) if n >= j else h[-1][:0])
            ok.append(ok[-1][: n - j + 1] & ok[1][j - 1 :] if n >= j else ok[-1][:0])
        good = ok[k]
        if k > 1:
            before = self._hashes(h[k - 1])
            frequent = np.zeros(len(before), bool)
            frequent[ok[k - 1]] = _bit(self.items, before[ok[k - 1]])
            good = good & frequent[: len(good)] & frequent[1 : len(good) + 1]
            good[good] = _bit(self.buckets, self._hashes(h[k])[good])
        if k < self.longest:
            both = ok[k + 1] & good[:-1][: len(ok[k + 1])] & good[1:][: len(ok[k + 1])] if len(ok[k + 1]) else ok[k + 1]
            found, counts = np.unique(self._hashes(h[k + 1])[both], return_counts=True)
            self.sums[found] += counts
        place = np.flatnonzero(good)
        # phrases are numbered exactly: the number of the first words, then the next word's code
        number = lang[place]
        for j in range(k):
            _, number = np.unique(number * np.int64(len(names)) + at[place + j], return_inverse=True)
        _, first, counts = np.unique(number, return_index=True, return_counts=True)
        first = place[first]
        words = pa.array(names, pa.large_string())
        phrase = pc.binary_join_element_wise(*(words.take(pa.array(at[first + j])) for j in range(k)), pa.scalar(" ", pa.large_string()))
        kinds = pa.array(langs_, pa.string()).take(pa.array(lang[first]))
        yield _rows(kinds, phrase.cast(pa.string()), self._hashes(h[k])[first], counts)
        if k == 1:
            total = np.bincount(lang[at >= 0], minlength=len(langs_))
            yield _rows(pa.array(langs_, pa.string()), pa.nulls(len(langs_), pa.string()), np.full(len(langs_), TOTAL), total)

    def rest(self) -> pa.RecordBatch:
        there = np.flatnonzero(self.sums)
        none = pa.nulls(len(there), pa.string())
        return _rows(none, none, there, self.sums[there])


def _rows(lang: pa.Array, phrase: pa.Array, bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(bucket.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "phrase", "bucket", "n"])


def _bitmap(buckets: DataFrame, size: int) -> np.ndarray:
    """The set bits of (bucket) rows as bytes: at most size / 32 rows come to the driver, whatever the table's."""
    words = buckets.groupBy(F.shiftright("bucket", 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bucket") % 32).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(size // 32, np.uint32)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, buckets: int = BUCKETS) -> list[DataFrame]:
    """A written table (lang, phrase, f) for each number of words from 1 to ``longest``: phrases of ``least`` occurrences
    or more. The first has one more row a language, without a phrase: all its words."""
    if buckets & (buckets - 1) or buckets < 32:
        raise ValueError("buckets: a power of two, 32 or more")
    at = common.bound_batches(docs).select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    context = docs.sparkSession.sparkContext
    out: list[DataFrame] = []
    maps = context.broadcast((None, None))
    for k in range(1, longest + 1):

        def count(batches: Iterator[pa.RecordBatch], k: int = k, maps=maps) -> Iterator[pa.RecordBatch]:
            counter = _Counter(k, *maps.value, longest, buckets)
            for batch in batches:
                if batch.num_rows:
                    yield from counter.batch(batch.column(0), batch.column(1))
            yield counter.rest()

        # phrases, buckets and totals are added up together, and only those that have enough are written
        rows = at.mapInArrow(count, "lang string, phrase string, bucket long, n long").groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n"))
        rows = common.written(rows.where((F.col("n") >= least) | (F.col("bucket") < 0)), f"counts-{k}")
        named = F.col("phrase").isNotNull()
        out.append(rows.where(named | (F.col("bucket") < 0)).select("lang", "phrase", F.col("n").alias("f")))
        if k < longest:
            maps = context.broadcast((_bitmap(rows.where(named), buckets), _bitmap(rows.where(~named & (F.col("bucket") >= 0)), buckets)))
    return out


def _words(phrase: Column, first: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def _big(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def scored(counts: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all phrases of two words or more, by the cut with the lowest score, the first of equal ones.

    A phrase's parts are at least as frequent as itself, so all of them have been counted. A part that many
    phrases share, as a first word, is joined where the phrases are.
    """
    parts = common.written(reduce(DataFrame.unionByName, counts), "parts")
    cuts = []
    for k, f in enumerate(counts[1:], 2):
        cuts += [f.select("lang", "phrase", F.col("f").alias("a"), F.lit(j).alias("cut"), _words(F.col("phrase"), 1, j).alias("first"), _words(F.col("phrase"), j + 1, k - j).alias("rest")) for j in range(1, k)]
    at = common.written(reduce(DataFrame.unionByName, cuts), "cuts")
    total = at.count()
    for part, name in (("first", "l"), ("rest", "r")):
        asked = at.groupBy("lang", part).agg(F.count("*").alias("asked"))
        few = parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)).hint("merge").join(asked, ["lang", part])
        at = common.written(common.hot_join(at, common.written(few, f"parts-{part}"), ["lang", part], "asked", total).drop("asked", part), f"cuts-{part}")
    score = (_big(F.lit(SCALE)) * F.col("a").cast("decimal(20,0)")).cast("decimal(38,0)")
    at = at.withColumn("big", score).withColumn("score", F.expr("big div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long"))
    best = F.min(F.struct("score", "cut", "l", "r")).alias("x")
    return at.groupBy("lang", "phrase").agg(F.max("a").alias("a"), best).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def absorbed(counts: list[DataFrame], share: int = ABSORBED) -> DataFrame:
    """(lang, phrase) of the phrases that lie within a longer one with ``share`` hundredths of their occurrences or more."""
    inner = []
    for k, f in enumerate(counts[2:], 3):
        for j in range(2, k):
            inner += [f.select("lang", _words(F.col("phrase"), i, j).alias("phrase"), "f") for i in range(1, k - j + 2)]
    if not inner:
        return counts[0].select("lang", "phrase").where("false")
    most = reduce(DataFrame.unionByName, inner).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    own = reduce(DataFrame.unionByName, counts[1:])
    return own.hint("merge").join(most, ["lang", "phrase"]).where(_big(F.lit(100)) * F.col("longer").cast("decimal(20,0)") >= _big(F.lit(share)) * F.col("f").cast("decimal(20,0)")).select("lang", "phrase")


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank; large tables are cut group by group before."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    n = rows.count()
    while n > max(RANKED, top):
        groups = -(-n // max(RANKED, 2 * top))
        within = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
        rows = common.written(rows.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top).drop("rank"), "ranked-phrases")
        before, n = n, rows.count()
        if n > before // 2:  # so many languages that each has few rows
            break
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = ABSORBED, buckets: int = BUCKETS) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, null languages are ``und``; repeated rows count as often as they occur; an empty
    table, or one without frequent phrases, gives no rows; other columns do not matter. Of equal scores the
    more frequent phrase comes first, then the first in order of UTF-8 bytes.
    """
    counts = counted(docs, text_col, lang_col, longest, least, buckets)
    n = common.maybe_broadcast(common.written(counts[0].where("phrase is null").select("lang", F.col("f").alias("n")), "words-by-lang"))
    counts[0] = counts[0].where("phrase is not null")
    gone = common.written(absorbed(counts, share), "absorbed")
    left = common.written(scored(counts).join(gone.hint("merge"), ["lang", "phrase"], "left_anti"), "scored")
    return _first(left, top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
