"""Sum-of-squares online packing of token sequences, without a shuffle.

Each task packs the documents of its own input partition. Of a document the full windows close at
once; its remainder goes to the fill level that makes the sum of the squared counts of partly filled
windows smallest, over an array of counts by level. At the end of a partition the windows still open
are joined and cut again into full ones; what is left over is cut at powers of two, so that no
position at all is padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import common
from lodestack.llm.tokenizing import batch_tokenizer, parts

END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Levels:
    """Partly filled windows: ``count[h]`` of them hold h tokens; ``open[h]`` are their pieces, last in first out."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def choose(self, size: int) -> int:
        """The level h (0: a new window) for which moving a window from h to h + size adds least to the
        sum of squares; of equals the fullest. From h goes 2 n(h) - 1, at h + size comes 2 n(h + size) + 1
        unless the window is then full and closes."""
        last = self.window - size
        gain = 2 * self.count[size : self.window + 1] + 1
        gain[last] = 0
        gain[1:] -= 2 * self.count[1 : last + 1] - 1
        gain[1:][self.count[1 : last + 1] == 0] = np.iinfo(np.int64).max
        return int(last - np.argmin(gain[::-1]))

    def place(self, piece: tuple) -> list | None:
        """Puts a piece (..., ids) shorter than the window in; returns the pieces of the window if it is full now."""
        size = len(piece[-1])
        h = self.choose(size)
        pieces = self.open[h].pop() if h else []
        self.count[h] -= h > 0
        pieces.append(piece)
        if h + size == self.window:
            return pieces
        self.count[h + size] += 1
        self.open.setdefault(h + size, []).append(pieces)
        return None

    def rest(self) -> list[tuple]:
        """All pieces of open windows, fullest windows first."""
        return [p for h in sorted(self.open, reverse=True) for pieces in self.open[h] for p in pieces]


def _cut(pieces: list[tuple], window: int) -> Iterator[list[tuple]]:
    """Cuts pieces (id, start, total, ids) into full windows and then into powers of two."""
    left = sum(len(p[-1]) for p in pieces)
    now, room = [], 0
    for doc, start, total, ids in pieces:
        while len(ids):
            if not room:
                room = window if left >= window else 1 << (left.bit_length() - 1)
            take = min(room, len(ids))
            now.append((doc, start, total, ids[:take]))
            ids, start, room, left = ids[take:], start + take, room - take, left - take
            if not room:
                yield now
                now = []


def pack(batches: Iterator[tuple[list, np.ndarray, np.ndarray]], window: int) -> Iterator[list[tuple]]:
    """Sequences, each a list of pieces (id, start, total, ids), of batches (ids of documents, tokens, where each begins)."""
    levels = Levels(window)
    for docs, flat, starts in batches:
        for doc, a, b in zip(docs, starts[:-1], starts[1:]):
            ids = np.append(flat[a:b], np.uint32(END_ID))
            total = len(ids)
            full = total - total % window
            for at in range(0, full, window):
                yield [(doc, at, total, ids[at : at + window])]
            if full < total and (done := levels.place((doc, full, total, ids[full:].copy()))):
                yield done
    yield from _cut(levels.rest(), window)


def packed(docs: DataFrame, tokenizer: str, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``with_ids`` the piece's ``ids`` themselves.

    ``window`` is a power of two. A null text is empty and has the end id alone; a null id stays null.
    Rows that repeat are packed each. An empty table gives no rows. Other columns are not read.
    Memory: open windows only, no more than a few for each level.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = batch_tokenizer(tokenizer).encode
        first = TaskContext.get().partitionId() << 36

        def read():
            for x in batches:
                for a, b in parts(x.column(1)):
                    yield x.column(0).slice(a, b - a).to_pylist(), *tokenize(x.column(1).slice(a, b - a))

        def table(rows):
            cols = list(zip(*rows))
            out = [pa.array(c, pa.int64()) for c in cols[:7]]
            return pa.RecordBatch.from_arrays([*out, pa.array(cols[7], pa.list_(pa.int32()))] if with_ids else out, names=names)

        names = [f.split()[0] for f in SCHEMA.split(", ")] + ["ids"] * with_ids
        rows: list[tuple] = []
        for n, sequence in enumerate(pack(read(), window)):
            offset = 0
            for doc, start, total, ids in sequence:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, first + n, offset) + ((ids,) if with_ids else ()))
                offset += len(ids)
            if len(rows) >= 8192:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.bound_batches(slim).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
