"""Transcript parsing: roles of lines by a hidden Markov model, then canonical turns.

A line shows its speaker's marker if it has one, whether it begins a paragraph, its length, a question, a
list item; nothing else is known of it. The model's tables are counts over labelled transcripts. Lines are
dealt into blocks by their number, so that no task ever holds a whole conversation: a block is first a
max-plus matrix from the role before it to the role at its end; the best roles at the borders follow from
these, and each block is then decoded between its borders. The path is the exact best one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm import common

ROLES = ("system", "user", "assistant")
#: Speaker markers at the start of a line, by role.
MARKERS = {
    "system": r"(?i)^\s*(?:\[|<\||\*\*|#+\s*)?(?:system|context|instructions?)(?:\|>|\]|\*\*)?\s*:\s*",
    "user": r"(?i)^\s*(?:\[|<\||\*\*|#+\s*)?(?:user|human|customer|question|me|q)(?:\|>|\]|\*\*)?\s*:\s*",
    "assistant": r"(?i)^\s*(?:\[|<\||\*\*|#+\s*)?(?:assistant|bot|ai|agent|answer|a)(?:\|>|\]|\*\*)?\s*:\s*",
}
#: Words at which a line's length class changes; classes of lines in all.
LENGTHS = (4, 8, 16, 32, 64)
CODES = 4 * 3 * (len(LENGTHS) + 1) * 2 * 2
#: Lines of a block.
BLOCK = 262_144
#: Lines that a task steps through at once, conversations side by side.
BATCH = 65_536
#: How transcripts name speakers, and write the names.
NAMES = {"system": ("System", "Context"), "user": ("User", "Human", "Customer"), "assistant": ("Assistant", "Bot", "Agent")}
FORMS = ("{}: ", "[{}]: ", "**{}**: ", "<|{}|>: ", "### {}: ")


def marker(line: Column) -> Column:
    """0 without a speaker's marker, else the role's number from 1."""
    return F.when(line.rlike(MARKERS["system"]), 1).when(line.rlike(MARKERS["user"]), 2).when(line.rlike(MARKERS["assistant"]), 3).otherwise(0)


def code(line: Column, begins: Column) -> Column:
    """A line's features as one number below CODES; ``begins`` is 2 at the start of a transcript, 1 of a paragraph or behind a marker."""
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    length = sum(((n >= x).cast("int") for x in LENGTHS), F.lit(0))
    ask, item = line.rlike(r"\?\s*$").cast("int"), line.rlike(r"^\s*(?:[-*•]|\d+[.)]|```)").cast("int")
    return (((marker(line) * 3 + begins) * (len(LENGTHS) + 1) + length) * 2 + ask) * 2 + item


def transcribed(conversations: DataFrame) -> DataFrame:
    """Conversations as transcripts tell them: (conv_id, turn, text, role) with a speaker's marker in one of several
    forms before every second turn or so, and none before the others. Turns follow on each other after a blank line."""
    pick = F.xxhash64("conv_id", "turn", F.lit("marker"))
    marked = F.lit(None).cast("string")
    for role, names in NAMES.items():
        every = F.array(*(F.lit(form.format(name)) for form in FORMS for name in names))
        marked = F.when(F.col("role") == role, F.get(every, F.pmod(pick, F.lit(len(FORMS) * len(names))).cast("int"))).otherwise(marked)
    shown = F.pmod(F.shiftright(pick, 32), F.lit(2)) == 0
    return conversations.select("conv_id", "turn", F.concat(F.when(shown, F.coalesce(marked, F.lit(""))).otherwise(""), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"), "role")


def _turn(turn: Column) -> Column:
    return F.coalesce(turn.cast("long"), F.lit(-1))


def transcript_lines(rows: DataFrame, *more: str) -> DataFrame:
    """Lines (conv_id, turn, h, line_no, code, begins) of rows (conv_id, turn, text), one of a transcript's pieces each.

    A piece is a turn, a page or the whole transcript; what begins it begins a paragraph, as does a line after
    an empty one or with a marker. A null text is one empty line and a null piece comes first.
    """
    at = rows.select("conv_id", _turn(F.col("turn")).alias("turn"), *more, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = F.split("text", "\n")
    before = F.concat(F.array(F.lit("")), F.slice(lines, F.lit(1), F.size(lines) - 1))
    at = at.select("conv_id", "turn", *more, F.xxhash64("text").alias("h"), F.posexplode(F.arrays_zip(lines.alias("line"), before.alias("before"))).alias("line_no", "x"))
    begins = F.when((F.col("turn") <= 0) & (F.col("line_no") == 0), 2).when((F.trim("x.before") == "") | (marker(F.col("x.line")) > 0), 1).otherwise(0)
    return at.select("conv_id", "turn", *more, "h", "line_no", code(F.col("x.line"), begins).cast("int").alias("code"), begins.alias("begins"))


def fitted(labelled: DataFrame) -> dict[str, np.ndarray]:
    """The model's log probabilities ``start``, ``stay`` (within a paragraph), ``move`` (to the next paragraph) and ``emit``
    from labelled transcripts (conv_id, turn, text, role): counts over all rows, summed before they reach the
    driver as tables of fixed size. A marker and the rest of a line count as independent, so that unseen pairs
    keep what each says; that a line begins a paragraph is given. Rows of other roles teach nothing."""
    roled = labelled.withColumn("r", F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1).where("r >= 0")
    lines = transcript_lines(roled, "r")
    counts = lines.groupBy("r", "code", "begins", (F.col("line_no") == 0).alias("first")).count()
    turns = roled.select("conv_id", _turn(F.col("turn")).alias("turn"), "r")
    then = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("r").alias("before"))
    moves = turns.join(then, ["conv_id", "turn"]).groupBy("before", "r").count()
    k = len(ROLES)
    seen, start, move = np.zeros((k, 4, 3, CODES // 12)), np.full(k, 0.5), np.full((k, k), 0.5)
    for row in counts.collect():  # at most a few rows for each role and code
        seen.reshape(k, CODES)[row["r"], row["code"]] += row["count"]
        if row["begins"] == 2:
            start[row["r"]] += row["count"]
        elif row["begins"] == 1 and not row["first"]:
            move[row["r"], row["r"]] += row["count"]
    for row in moves.collect():
        move[row["before"], row["r"]] += row["count"]
    own = np.hstack([np.zeros((k, 1)), np.eye(k)])  # one sighting of each role's own marker
    marks, rest = seen.sum(axis=(2, 3)) + own + 0.1, seen.sum(axis=(1, 2)) + 0.5
    marks, rest = marks / marks.sum(axis=1, keepdims=True), rest / rest.sum(axis=1, keepdims=True)
    emit = np.broadcast_to(marks[:, :, None, None] * rest[:, None, None, :], seen.shape).reshape(k, CODES)
    stay = np.full((k, k), 1e-4) + np.eye(k) * (1 - k * 1e-4)
    return {"start": np.log(start / start.sum()), "move": np.log(move / move.sum(axis=1, keepdims=True)), "stay": np.log(stay), "emit": np.log(emit)}


class Steps:
    """Runs of lines side by side: the t-th step takes the t-th line of every run that has one."""

    def __init__(self, model: dict, codes: np.ndarray, begins: np.ndarray, edges: np.ndarray):
        k = len(ROLES)
        self.codes, self.begins, self.emit = codes, begins, np.ascontiguousarray(model["emit"].T)
        self.moves = np.stack([model["stay"], model["move"], np.tile(model["start"], (k, 1))])
        sizes = np.diff(edges)
        self.order = np.argsort(-sizes, kind="stable")
        self.first, self.sizes = edges[:-1][self.order], sizes[self.order]
        self.active = [int(x) for x in np.searchsorted(-self.sizes, -np.arange(self.sizes[0] if len(sizes) else 0), "left")]

    def lines(self, t: int) -> np.ndarray:
        return self.first[: self.active[t]] + t

    def scores(self, at: np.ndarray) -> np.ndarray:
        """Of lines the scores from each role before to each own."""
        return self.moves[self.begins[at]] + self.emit[self.codes[at]][:, None, :]

    def matrices(self) -> np.ndarray:
        """Best score from each role before a run to each role at its end."""
        k = len(ROLES)
        total = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(len(self.order), axis=0)
        for t in range(len(self.active)):
            m = self.active[t]
            total[:m] = (total[:m, :, :, None] + self.scores(self.lines(t))[:, None]).max(axis=2)
        out = np.empty_like(total)
        out[self.order] = total
        return out

    def best(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The lines' best roles, given each run's scores of the roles before it and, unless negative, the role of its last line."""
        score = before[self.order].copy()
        back = np.zeros((len(self.codes), len(ROLES)), np.int8)
        for t in range(len(self.active)):
            m, at = self.active[t], self.lines(t)
            both = score[:m, :, None] + self.scores(at)
            back[at] = both.argmax(axis=1)
            score[:m] = both.max(axis=1)
        now = np.where(last[self.order] < 0, score.argmax(axis=1), last[self.order])
        roles = np.zeros(len(self.codes), np.int32)
        for t in reversed(range(len(self.active))):
            m, at = self.active[t], self.lines(t)
            roles[at] = now[:m]
            now[:m] = back[at, now[:m]]
        return roles


def _edges(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups begin in rows sorted by keys, and the end."""
    change = np.zeros(t.num_rows, bool)
    change[:1] = True
    for c in keys:
        x = t[c].combine_chunks().dictionary_encode(null_encoding="encode")
        x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        i = x.indices.to_numpy(zero_copy_only=False)
        change[1:] |= i[1:] != i[:-1]
    return np.r_[np.flatnonzero(change), t.num_rows]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, of ``least`` rows or more where there are as many, with the groups' edges, from rows sorted by keys."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rest.append(batch)
        if sum(b.num_rows for b in rest) >= least:
            t = pa.Table.from_batches(rest)
            edges = _edges(t, keys)
            if len(edges) > 2:
                yield t.slice(0, edges[-2]), edges[:-1]
            rest = t.slice(edges[-2]).to_batches()
            least = max(least, 2 * (edges[-1] - edges[-2]))  # a group of many rows is not cut anew for each batch
    if rest and (t := pa.Table.from_batches(rest)).num_rows:
        yield t, _edges(t, keys)


def decoded(lines: DataFrame, model: dict[str, np.ndarray], n_lines: int) -> DataFrame:
    """The lines' roles: (conv_id, turn, h, line_no, role), by the best path through each whole transcript.

    ``n_lines`` says how many lines there are about, from which the number of blocks follows.
    """
    kind = dict(lines.dtypes)["conv_id"]
    keys, place, k = ["conv_id", "block"], ["turn", "h", "line_no"], len(ROLES)

    def runs(t: pa.Table, edges: np.ndarray) -> Steps:
        return Steps(model, t["code"].to_numpy(), t["begins"].to_numpy(), edges)

    def sums(batches):
        for t, edges in _groups(batches, keys, BATCH):
            first = t.take(edges[:-1])
            yield pa.RecordBatch.from_arrays([*(first[c].combine_chunks() for c in keys), pa.array(runs(t, edges).matrices().reshape(-1, k * k).tolist())], names=[*keys, "m"])

    def borders(batches):
        for t, edges in _groups(batches, ["conv_id"], 1024):
            befores, ends = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                score, back = model["start"], []
                for m in t["m"].slice(a, b - a).to_pylist():
                    both = score[:, None] + np.asarray(m).reshape(k, k)
                    befores.append(score.tolist())
                    back.append(both.argmax(axis=0))
                    score = both.max(axis=0)
                path = [int(score.argmax())]
                for step in reversed(back[1:]):
                    path.append(int(step[path[-1]]))
                ends += path[::-1]
            yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in keys), pa.array(befores, pa.list_(pa.float64())), pa.array(ends, pa.int32())], names=[*keys, "before", "last"])

    def paths(batches):
        for t, edges in _groups(batches, keys, BATCH):
            first = t.take(edges[:-1])
            before = np.array([x or model["start"].tolist() for x in first["before"].to_pylist()])
            last = np.array([-1 if x is None else x for x in first["last"].to_pylist()])
            roles = runs(t, edges).best(before, last)
            yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in ("conv_id", *place)), pa.array(roles)], names=["conv_id", *place, "role"])

    blocks = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_lines // BLOCK))
    lines = lines.repartitionByRange(blocks, "conv_id", *place).withColumn("block", F.spark_partition_id())
    lines = common.written(lines, "transcript-lines")
    long = lines.groupBy(*keys).count().groupBy("conv_id").count().where("count > 1").select("conv_id")
    long = common.written(long, "long-transcripts")
    more = lines.join(long, lines["conv_id"].eqNullSafe(long["conv_id"]), "left_semi")
    matrices = more.repartition(*keys).sortWithinPartitions(*keys, *place).mapInArrow(sums, f"conv_id {kind}, block int, m array<double>")
    fixed = matrices.repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(borders, f"conv_id {kind}, block int, before array<double>, last int")
    fixed = common.written(fixed.toDF("_c", "_b", "before", "last"), "borders")
    known = lines.join(fixed, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")), "left").drop("_c", "_b")
    return known.repartition(*keys).sortWithinPartitions(*keys, *place).mapInArrow(paths, f"conv_id {kind}, turn long, h long, line_no int, role int")


def formatted(rows: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Each piece of a transcript (conv_id, turn, text) with its recovered role and canonical text: conv_id, turn, role, n_lines, rendered.

    Roles come from the text alone. A piece whose lines change roles is rendered as several turns; ``role``
    is its first line's. Markers leave the text. Rows that repeat are rendered each; null texts are one
    empty line; transcripts and pieces without an id are one transcript, and its first piece; an empty table
    gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = transcript_lines(rows).dropDuplicates(["conv_id", "turn", "h", "line_no"])
    n_lines = rows.agg(F.coalesce(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1), F.lit(0))).first()[0]
    roles = decoded(lines, model, n_lines).groupBy("conv_id", "turn", "h").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "role"))), lambda x: x["role"]).alias("roles"))
    roles = roles.toDF("_c", "_t", "_h", "roles")
    at = rows.select("conv_id", _turn(F.col("turn")).alias("turn"), text.alias("text"), F.xxhash64(text).alias("h"))
    at = at.join(roles, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t")) & (F.col("h") == F.col("_h")))
    name = lambda r: F.element_at(F.array(*map(F.lit, ROLES)), r + 1)
    unmarked = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, MARKERS["system"], ""), MARKERS["user"], ""), MARKERS["assistant"], ""))
    before = F.concat(F.array(F.lit(-1)), F.slice("roles", F.lit(1), F.size("roles") - 1))
    zipped = F.arrays_zip(unmarked.alias("x"), F.col("roles").alias("r"), before.alias("b"))
    head = lambda z: F.concat(F.when(z["b"] >= 0, "<|end|>\n").otherwise(""), F.lit("<|"), name(z["r"]), F.lit("|>\n"))
    body = F.array_join(F.transform(zipped, lambda z: F.concat(F.when(z["r"] != z["b"], head(z)).otherwise(""), z["x"])), "\n")
    return at.select("conv_id", "turn", name(F.get("roles", F.lit(0))).alias("role"), F.size("roles").cast("long").alias("n_lines"), F.concat(body, F.lit("\n<|end|>\n")).alias("rendered"))


def held_out(conversations: DataFrame) -> DataFrame:
    """``formatted`` transcripts of conversations: those of each half are parsed by a model fitted to the other half."""
    rows = transcribed(conversations).withColumn("half", F.pmod(F.xxhash64("conv_id"), F.lit(2)))
    parts = [formatted(rows.where(F.col("half") == i), fitted(rows.where(F.col("half") != i))) for i in (0, 1)]
    return parts[0].unionByName(parts[1])
