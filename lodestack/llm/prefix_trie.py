"""Prefix trie of conversations: digest-keyed nodes, rolled up by pointer jumping.

A node is the sequence of a conversation's first d turns. Its key is the exclusive or of 128-bit hashes of
its turns, each with its position, so that keys are prefix sums, which are worked out block by block, and
a parent's key follows from its child's. Sums over subtrees take a number of rounds that grows with the
logarithm of the depth: each round a node passes what it has gathered to its pointer, and the pointer jumps
to the pointer's pointer. No conversation, node or subtree is gathered into one task: rows of one
conversation are ranked by ranges, prefixes by blocks, and joins on a parent split hot parents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm import common

#: Conversations of one hundred begin as the first of them does, with up to five of its turns.
FAMILY, MOST_SHARED = 100, 5
#: Turns in a block of a conversation, and conversations in a block of a node's digest.
BLOCK = 1024


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")


def ranked(conversations: DataFrame) -> DataFrame:
    """(c, r, h1, h2, size) of every turn: its conversation, place from 1, hash and length in code points.

    Turns are in the order of ``turn``, null first; of one turn's rows by their hashes. Null roles and texts
    are empty; rows without a conversation are left out. Ranks are those within a range of (conversation,
    turn) plus the rows of the earlier ranges, so that a long conversation is many ranges.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("t"),
        F.xxhash64(role, F.length(role), text).alias("h1"), F.xxhash64(F.lit(7), text, F.length(role), role).alias("h2"), F.length(text).cast("long").alias("size"),
    )
    # rows that are equal throughout take any order; the random number lets ranges part them
    slim = common.written(slim.withColumn("tie", F.rand(11)), "turns")
    order = [F.col("t").asc_nulls_first(), "h1", "h2", "tie"]
    # a stated number of ranges is one that adaptive execution leaves as it is
    ranges = slim.repartitionByRange(int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c", *order).withColumn("part", F.spark_partition_id())
    ranges = common.written(ranges.withColumn("own", F.row_number().over(Window.partitionBy("part", "c").orderBy(*order))), "turn-ranges")
    filled = ranges.groupBy("c", "part").agg(F.max("own").alias("n"))
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.withColumn("start", F.sum("n").over(earlier)).where("start is not null").select("c", "part", "start")
    at = ranges.join(common.maybe_broadcast(common.written(starts, "range-starts")), ["c", "part"], "left")
    return at.select("c", (F.col("own") + F.coalesce("start", F.lit(0))).alias("r"), "h1", "h2", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``ranked()``, written: (c, d, h1, h2, size) of all rebuilt turns, and (c, total) of all conversations.

    Conversation c begins with the first h turns of c - c % 100 as it was (all if there are fewer, none if
    it is absent), and goes on with its own turns after its first h.
    """
    sizes = common.written(turns.groupBy("c").agg(F.count("*").alias("n")), "conversation-sizes")
    base = sizes.withColumn("h", shared_turns(F.col("c"))).withColumn("b", F.col("c") - F.col("c") % FAMILY)
    of = sizes.select(F.col("c").alias("b"), F.col("n").alias("base_n"))
    base = base.join(of.hint("merge"), "b", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    base = common.written(base.select("c", "b", "n", "h", "m"), "bases")
    heads = turns.where((F.col("r") <= MOST_SHARED) & (F.col("c") % FAMILY == 0)).withColumnRenamed("c", "b")
    # at most a hundred conversations have one base
    first = heads.join(base.select("c", "b", "h").hint("merge"), "b").where("r <= h").select("c", F.col("r").alias("d"), "h1", "h2", "size")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = common.hot_join(turns, base.select("c", "n", "h", "m"), ["c"], "n", total).where("r > h")
    own = own.select("c", (F.col("r") - F.col("h") + F.col("m")).alias("d"), "h1", "h2", "size")
    totals = base.select("c", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    return first.unionByName(own), totals


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, d, k1, k2, p1, p2, size) of ``rebuilt()`` turns: the key of the prefix that each ends, and its parent's."""
    at = turns.withColumns({f"x{i}": F.xxhash64(F.lit(i), "d", "h1", "h2") for i in (1, 2)}).withColumn("block", F.floor((F.col("d") - 1) / BLOCK))
    upto = Window.partitionBy("c", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    at = common.written(at.select("c", "d", "block", "size", "x1", "x2", *(F.bit_xor(f"x{i}").over(upto).alias(f"w{i}") for i in (1, 2))), "blocks")
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    long = at.groupBy("c", "block").agg(*(F.bit_xor(f"x{i}").alias(f"b{i}") for i in (1, 2)))
    starts = long.select("c", "block", *(F.bit_xor(f"b{i}").over(earlier).alias(f"s{i}") for i in (1, 2))).where("block > 0")
    # a block has BLOCK rows at most, so no key of this join is hot; few conversations have a second block
    at = at.join(common.maybe_broadcast(common.written(starts, "block-starts")), ["c", "block"], "left")
    key = {i: F.col(f"w{i}").bitwiseXOR(F.coalesce(f"s{i}", F.lit(0).cast("long"))) for i in (1, 2)}
    return at.select("c", "d", "size", *(key[i].alias(f"k{i}") for i in (1, 2)), *(key[i].bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)))


def nodes(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(k1, k2, p1, p2, conv_id, depth, n_convs, size) of every node; the root has key zero, no parent and all conversations."""
    at = found.groupBy("k1", "k2", "d").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("size").alias("size"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = totals.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("size"))
    return at.select("k1", "k2", "p1", "p2", "conv_id", F.col("d").cast("long").alias("depth"), "n_convs", "size").unionByName(root)


def rolled_up(tree: DataFrame) -> DataFrame:
    """Written ``nodes()`` with n_children, n_leaves, saved_tokens and parent_conv_id, by pointer jumping.

    After round k a node has the sums of what lies less than 2^k below it, and points to the node 2^k above
    it, or to none. Every round is a written table; nodes that point nowhere are only read again.
    """
    up = ["p1", "p2"]
    children = common.written(tree.where("p1 is not null").groupBy(*up).agg(F.count("*").alias("n_children")), "children")
    named = children.join(tree.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")).hint("merge"), up)
    named = common.written(named, "parents")
    below = named.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    start = tree.join(below.hint("merge"), ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    start = start.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("size"))
    start = common.written(start, "trie-0")
    state = start.select("k1", "k2", "p1", "p2", "depth", "n_leaves", "saved_tokens")
    deepest = state.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    step = 1
    while step <= deepest:
        sums = state.where("p1 is not null").groupBy(*up).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"), F.count("*").alias("n"))
        sums = common.written(sums, f"sums-{step}")
        got = sums.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "more_leaves", "more_saved")
        state = state.join(got.hint("merge"), ["k1", "k2"], "left")
        state = state.withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0)))
        state = common.written(state.drop("more_leaves", "more_saved"), f"gathered-{step}")
        # a pointer that is deep enough has one of its own; its key is hot if much points to it
        far = F.col("depth") >= 2 * step
        jump = state.where(F.col("depth") >= step).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        jump = common.written(sums.select(*up, "n").join(jump.hint("merge"), up), f"jumps-{step}")
        active = state.where(far)
        moved = common.hot_join(active, jump, up, "n", active.count()).select("k1", "k2", F.col("q1").alias("p1"), F.col("q2").alias("p2"), "depth", "n_leaves", "saved_tokens")
        rest = state.where(~far).withColumns({"p1": F.lit(None).cast("long"), "p2": F.lit(None).cast("long")})
        state = common.written(moved.unionByName(rest), f"trie-{2 * step}")
        step *= 2
    done = start.drop("n_leaves", "saved_tokens").join(state.select("k1", "k2", "n_leaves", "saved_tokens").hint("merge"), ["k1", "k2"])
    total = start.count()
    below_root = common.hot_join(done.where("p1 is not null"), named.withColumnRenamed("n_children", "siblings"), up, "siblings", total)
    root = done.where("p1 is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below_root.drop("siblings").unionByName(root)


def _sha_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (k1, k2, ids) sorted by node and block: one digest for each node, of its blocks joined by commas."""
    key, sha = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"k1": pa.array([key[0]], pa.int64()), "k2": pa.array([key[1]], pa.int64()), "sha": pa.array([sha.hexdigest()], pa.string())})

    for batch in batches:
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
            if (k1, k2) == key:
                sha.update(b"," + ids.encode())
            else:
                if key is not None:
                    yield out()
                key, sha = (k1, k2), hashlib.sha256(ids.encode())
    if key is not None:
        yield out()


def ends(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(k1, k2, sha) of the nodes at which conversations end: SHA-256 of their decimal ids, ascending, comma-joined.

    Ids are joined in blocks of ``BLOCK`` neighbouring numbers; a node of many blocks, which a hot conversation
    makes, is digested block after block in a stream.
    """
    zero = F.lit(0).cast("long")
    last = found.select("c", "d", "k1", "k2").join(totals.select("c", F.col("total").alias("d")).hint("merge"), ["c", "d"])
    last = last.select("c", "k1", "k2").unionByName(totals.where("total = 0").select("c", zero.alias("k1"), zero.alias("k2")))
    blocks = last.groupBy("k1", "k2", F.floor(F.col("c") / BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))
    blocks = common.written(blocks, "end-blocks")
    many = blocks.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    many = common.written(many, "end-nodes")
    one = many.where("n = 1").select("k1", "k2", F.sha2(F.col("ids").cast("binary"), 256).alias("sha"))
    long = common.bound_batches(blocks).join(many.where("n > 1").select("k1", "k2").hint("merge"), ["k1", "k2"], "left_semi")
    return one.unionByName(long.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").select("k1", "k2", "ids").mapInArrow(_sha_of_blocks, "k1 long, k2 long, sha string"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the rebuilt ``conversations (conv_id, turn, role, text)``: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; turns without a number come first; rows that repeat a turn are turns of
    their own, in the order of their hashes; rows without a conversation are left out. An empty table has
    no nodes, not even a root. Extra columns do not matter.
    """
    turns = common.written(ranked(conversations), "ranked-turns")
    all_turns, totals = rebuilt(turns)
    totals = common.written(totals, "totals")
    found = common.written(prefixes(all_turns), "prefixes")
    tree = rolled_up(common.written(nodes(found, totals), "nodes"))
    ended = common.written(ends(found, totals), "ends")
    sha = F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256))
    return tree.join(ended.hint("merge"), ["k1", "k2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))
