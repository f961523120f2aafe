"""Host-level quality rules: failure rates of hosts, shrunk by an empirical beta prior.

Rules of single texts come first, as SQL expressions over arrays of the row itself. Their failures are
summed by host; a beta prior is fitted to the hosts by their variance beyond that of sampling; a host is
rejected if, after its own documents, its rate is almost surely far above the corpus'; and that verdict
goes back to its documents. No text enters a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm import common

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host is rejected if, with at least this probability, its odds of failure are above so many times the corpus'.
MIN_PROBABILITY, MAX_ODDS = 0.95, 4.0
#: Documents that the prior may count for: at least one, so that no host falls by a document or two; at most where all hosts are as good as alike.
STRENGTHS = (1.0, 1e6)
#: Nodes on each side of the limit, of the sum that stands for a beta distribution's integral.
NODES = 200


def _but_first(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def _windows(h: Column) -> Column:
    """Hashes of all windows of three neighbours in ``h``."""
    pairs = F.zip_with(h, _but_first(h), lambda a, b: F.xxhash64(a, b))
    third = F.slice(h, F.lit(3), F.greatest(F.size(h) - 2, F.lit(0)))
    return F.slice(F.zip_with(pairs, third, lambda a, b: F.xxhash64(a, b)), F.lit(1), F.size(third))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, host and the base figures of every row, and with ``carry`` the row itself as ``row``.

    A null text is a text without words. Words of repeated windows: windows are sorted with their
    positions, so that equal ones are neighbours; the positions of repeated ones are sorted again, and
    each adds the words, three at most, that the next one does not cover. Words enter windows by 64-bit hash.
    """
    keep = ["row"] if carry else []
    own = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    at = docs.select(*own, F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    at = at.withColumn("w", common.words(F.col("text")))
    at = at.select(
        *keep, "doc_id", "host", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(common.WORD)).alias("lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    at = at.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).withColumn("windows", _windows(F.col("h")))
    at = at.withColumn("s", F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    # same[k]: whether the k-th window in sorted order equals the next one
    at = at.withColumn("same", F.zip_with(F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))), _but_first(F.col("s")), lambda a, b: a["h"] == b["h"]))
    no = F.array(F.lit(False))
    found = F.zip_with("s", F.zip_with(F.concat(no, "same"), F.concat("same", no), lambda a, b: a | b), lambda x, f: F.when(f, x["i"]))
    at = at.withColumn("p", F.array_sort(F.filter(found, lambda x: x.isNotNull())))
    covered = F.aggregate(F.zip_with("p", _but_first(F.col("p")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda acc, x: acc + x)
    at = at.withColumn("n_repeat_words", covered.cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return at.select(*keep, "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def beta_above(a: Column, b: Column, limit: Column) -> Column:
    """The probability that a beta(a, b) variable exceeds ``limit``, by the midpoint rule over its logit on both sides of the limit.

    On that scale the density is smooth and falls off exponentially, with rate a to the left and b to the right.
    """
    at = F.log(limit / (1 - limit))
    mode, spread = F.log(a / b), F.sqrt((a + b) / (a * b))
    low, high = mode - 12 * F.greatest(spread, 1 / a), mode + 12 * F.greatest(spread, 1 / b)
    peak = a * mode - (a + b) * F.log1p(F.exp(mode))
    nodes = F.sequence(F.lit(0), F.lit(NODES - 1))

    def mass(begin: Column, end: Column) -> Column:
        step = (end - begin) / NODES

        def add(acc: Column, k: Column) -> Column:
            u = begin + (k + 0.5) * step
            return acc + F.exp(a * u - (a + b) * F.when(u > 30, u).otherwise(F.log1p(F.exp(F.least(u, F.lit(30.0))))) - peak)

        return F.aggregate(nodes, F.lit(0.0), add) * step

    inner = F.least(F.greatest(at, low), high)
    right = mass(inner, high)
    return right / (mass(low, inner) + right)


def host_verdicts(figures: DataFrame, min_probability: float = MIN_PROBABILITY, max_odds: float = MAX_ODDS) -> DataFrame:
    """(host, n, failed, rate, limit, p_above, host_ok): failure rates shrunk by a beta prior that the hosts themselves give.

    The prior's mean is the corpus' rate. Its strength is that at which a beta distribution gives the
    correlation of documents within hosts (analysis of variance with unequal host sizes): hosts of few
    documents say little about it, and what sampling alone explains counts for nothing. ``limit`` is the
    rate of ``max_odds`` times the corpus' odds; ``p_above`` the probability that the host's rate exceeds it.
    """
    hosts = figures.groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    hosts = common.written(hosts, "hosts")
    n, x = F.col("n").cast("double"), F.col("failed").cast("double")
    sums = hosts.agg(F.sum(n).alias("total"), F.sum(x).alias("bad"), F.count("*").cast("double").alias("k"), F.sum(n * n).alias("squares"), F.sum(x * x / n).alias("between"))
    between = (F.col("between") - F.col("bad") * F.col("bad") / F.col("total")) / (F.col("k") - 1)
    within = (F.col("bad") - F.col("between")) / (F.col("total") - F.col("k"))
    size = (F.col("total") - F.col("squares") / F.col("total")) / (F.col("k") - 1)
    known = (F.col("k") > 1) & (F.col("total") > F.col("k"))
    prior = sums.select(
        (F.col("bad") / F.col("total")).alias("mean"),
        F.when(known, F.when(between > within, F.try_divide(between - within, between + (size - 1) * within))).alias("share"),
    )
    low, high = map(F.lit, STRENGTHS)
    strength = F.coalesce(F.least(high, F.greatest(low, 1 / F.col("share") - 1)), high)
    # the prior is one row
    shrunk = hosts.join(F.broadcast(prior)).withColumn("strength", strength)
    a, b = x + F.col("mean") * F.col("strength"), n - x + (1 - F.col("mean")) * F.col("strength")
    limit = max_odds * F.col("mean") / (1 + (max_odds - 1) * F.col("mean"))
    shrunk = shrunk.select("host", "n", "failed", a.alias("a"), b.alias("b"), limit.alias("limit"), (F.col("mean") > 0) & (F.col("mean") < 1))
    shrunk = shrunk.toDF("host", "n", "failed", "a", "b", "limit", "mixed")
    above = F.when(F.col("mixed"), beta_above(F.col("a"), F.col("b"), F.col("limit"))).otherwise(0.0)
    shrunk = shrunk.withColumn("rate", F.col("a") / (F.col("a") + F.col("b"))).withColumn("p_above", above)
    return common.written(shrunk.select("host", "n", "failed", "rate", "limit", "p_above", (F.col("p_above") < min_probability).alias("host_ok")), "host-verdicts")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_probability: float = MIN_PROBABILITY, max_odds: float = MAX_ODDS, carry: bool = False) -> DataFrame:
    """Every row's figures with host_rate, host_p_above and ``kept``: false if a base rule or the host's verdict rejects it.

    Null hosts are one host; rows that repeat are judged each and all count; an empty table gives no rows;
    where all documents fail, or none, no host differs from the corpus and none is rejected.
    """
    figures = common.written(measured(docs, id_col, text_col, host_col, carry), "figures")
    hosts = host_verdicts(figures, min_probability, max_odds)
    hosts = common.maybe_broadcast(hosts.select(F.col("host").alias("_h"), F.col("rate").alias("host_rate"), F.col("p_above").alias("host_p_above"), "host_ok"))
    out = figures.join(hosts, F.col("host").eqNullSafe(F.col("_h")))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("_h", "host_ok")


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_probability: float = MIN_PROBABILITY, max_odds: float = MAX_ODDS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; texts are written once with their figures."""
    return judged(docs, id_col, text_col, host_col, min_probability, max_odds, carry=True).where("kept").select("row.*")
