"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance
of two such vectors is at most the Hamming distance of the fingerprints. The segments are dealt into
groups; vectors at distance 3 or less agree in all groups but three at least, so each vector goes to the
grid cells that the counts of all but three groups name: 20 cells of six groups, and 56 of eight or 120 of
ten, which are far rarer, for more points. Within a cell pairs are filtered by Manhattan distance and then
by the fingerprints themselves, and only links that join something new are passed on. Equal
fingerprints are one point. Cells of many points are dealt into blocks, and pairs of blocks compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm import common

MAX_BITS, SHINGLE = 3, 3
LOW_BITS = 0x5555555555555555
#: Groups by the number of points from which they are used. A random point meets 4e-6, 2e-7 or 4e-8 of all others in its cells.
GROUPS_FROM = ((0, 6), (20_000_000, 8), (2_000_000_000, 10))
#: Points of a cell that are compared in one task at once.
BLOCK = 4096


def fingerprint(text: str | None) -> int:
    """SimHash of the 3-word shingles, as a signed 64-bit number; a text without words has 0."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) >= SHINGLE else [b" ".join(w)]
    n = max(1, len(w) - SHINGLE + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # in parts, to bound memory
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for t in text.to_pylist()], pa.int64())


def embedded(fp: Column) -> Column:
    """The bit count of every two-bit segment as 00, 01 or 11: Manhattan distance is then the number of differing bits."""
    low, high = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def groups(n: int) -> list[int]:
    """Bits of n groups of the 32 segments, as equal in size as can be."""
    edges = [2 * (32 * i // n) for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:])]


def cells(embedding: Column, n: int) -> Column:
    """The grid cells of a vector: for each choice of all but three of n groups, these groups' counts."""
    masks = [sum(chosen) for chosen in combinations(groups(n), n - MAX_BITS)]
    return F.array(*(F.struct(F.lit(i).alias("choice"), embedding.bitwiseAND(F.lit(_signed(m))).alias("counts")) for i, m in enumerate(masks)))


def _joins(rep: np.ndarray, fp: np.ndarray, emb: np.ndarray, run: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links among points of equal ``run``, without those whose ends earlier links have joined.

    ``side`` has the block of each point; in a run of two blocks only pairs across them count.
    """
    parent = np.arange(len(rep))
    found: list[tuple[int, int]] = []
    at, step, mixed = np.arange(len(rep)), 0, np.zeros(len(rep), bool)
    if len(rep):
        edge = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        two = np.minimum.reduceat(side, edge) != np.maximum.reduceat(side, edge)
        mixed = np.repeat(two, np.diff(np.r_[edge, len(rep)]))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    while len(at):
        step += 1
        at = at[at + step < len(rep)]
        at = at[run[at] == run[at + step]]
        b = at + step
        ok = (parent[at] != parent[b]) & (~mixed[at] | (side[at] != side[b]))
        a, b = at[ok], b[ok]
        near = np.bitwise_count(emb[a] ^ emb[b]) <= MAX_BITS
        a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= MAX_BITS
        for i, j in zip(a[near].tolist(), b[near].tolist()):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((int(rep[i]), int(rep[j])))
        if near.any():
            while (parent != parent[parent]).any():
                parent = parent[parent]
    return found


def _link_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by cell and block pair; the last, unfinished cell of a batch waits for the next one."""
    rest = None

    def links(t: pa.Table) -> pa.RecordBatch:
        key = np.stack([t[c].to_numpy() for c in ("choice", "counts", "first", "second")])
        run = np.r_[0, np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))] if t.num_rows else np.zeros(0, int)
        rep, side = t["rep"].to_numpy(), t["side"].to_numpy()
        fp, emb = (t[c].to_numpy().view(np.uint64) for c in ("fp", "embedding"))  # bits of signed numbers are counted by absolute value
        got = np.array(_joins(rep, fp, emb, run, side), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(got.max(axis=1, initial=0) if not len(got) else got.max(axis=1)), pa.array(got.min(axis=1) if len(got) else got[:, 0])], names=["u", "v"])

    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        last = [t[c][-1].as_py() for c in ("choice", "counts", "first", "second")] if t.num_rows else None
        same = np.ones(t.num_rows, bool)
        for c, x in zip(("choice", "counts", "first", "second"), last or ()):
            same &= t[c].to_numpy() == x
        whole = int(np.argmin(same[::-1])) if not same.all() else t.num_rows
        rest = t.slice(t.num_rows - whole)
        if t.num_rows - whole:
            yield links(t.slice(0, t.num_rows - whole))
    if rest is not None and rest.num_rows:
        yield links(rest)


def links(points: DataFrame, n_groups: int | None = None) -> DataFrame:
    """Links (u > v) that connect all points (rep, fp) at 3 or fewer bits; far from all pairs.

    The number of groups follows from the number of points; the links are exact with any.
    """
    if n_groups is None:
        n = points.count()
        n_groups = max(g for least, g in GROUPS_FROM if n >= least)
    there = points.select("rep", "fp", embedded(F.col("fp")).alias("embedding"))
    dealt = there.select("rep", "fp", "embedding", F.inline(cells(F.col("embedding"), n_groups)))
    large = common.written(dealt.groupBy("choice", "counts").count().where(F.col("count") > BLOCK), "large-cells")
    if large.isEmpty():
        dealt = dealt.select("*", F.lit(0).alias("first"), F.lit(0).alias("second"), F.lit(0).alias("side"))
    else:
        blocks = large.select("choice", "counts", F.ceil(F.col("count") / (BLOCK / 2)).cast("int").alias("blocks"))
        dealt = dealt.join(common.maybe_broadcast(blocks), ["choice", "counts"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("side", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumn("first", F.least("side", "other")).withColumn("second", F.greatest("side", "other")).drop("blocks", "other")
    keys = ["choice", "counts", "first", "second"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_link_cells, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every linked node, the smallest node it can reach, by alternating large and small stars.

    In a large-star round each node passes the smallest of its neighbours to its larger neighbours, in a
    small-star round to its smaller ones; both keep what is connected and end in stars. Each round is a
    written table. Minima are partial aggregates and the joins leave hot nodes to AQE.
    """
    edges = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = common.written(edges, "large-star")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), "m"), F.struct(F.col("u").alias("a"), "m"))).alias("x"))
        edges = common.written(small.select(F.col("x.a").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (hex), component_id.

    Null and empty texts have fingerprint zero and link to each other. Rows that repeat an id have its
    component each by their own text. A row without an id links nothing, and its component is that of
    the ids with its fingerprint, null if there are none. An empty table gives no rows.
    """
    slim = common.written(common.bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col).cast("string")).alias("fp")), "fingerprints")
    points = common.written(slim.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "points")
    found = components(links(points.where("rep is not null")))
    named = points.join(found, points["rep"] == found["node"], "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    total = points.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = common.hot_join(slim, common.written(named, "named-points"), ["fp"], "n", total)
    return met.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that give their group its id: one of each group, with all columns, whatever their names.

    Rows that repeat such an id with a text of its group stay too; exact dedup comes before.
    """
    (key,) = common.fresh(docs, "simhash_gone")
    gone = classes(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(common.written(gone, "gone"), F.col(id_col).cast("long") == F.col(key), "left_anti")
