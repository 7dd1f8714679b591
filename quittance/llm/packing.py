"""Sum-of-squares online packing of documents into sequences of a fixed length.

Each task packs its own rows in the order they arrive. A document's ids (with
the end id) are cut into full windows of `length`, each a sequence of its own;
the remainder goes as one piece into the open window whose fill level minimises
the sum of squared counts of partially filled windows. The counts are kept in a
level array, so that a placement looks at `length` levels and never at windows.

When a task ends, or holds more than `open_tokens` ids in open windows, the
windows whose fill is no power of two are emptied and their pieces laid end to end
into full windows, cut where a window fills; the tail of the last is split at powers of
two, which need no padding. So memory is bounded, each id lies in exactly one
piece, and padding does not grow with the number of tasks.

Cases: null and empty texts hold the end id alone; very long texts become many
full windows; repeated ids and texts are packed row by row; an empty table gives
no rows; other columns are not read, whatever their names. Null doc_ids stay null. sequence_id is unique over the table: the task's
partition in the upper bits, its own count in the lower 33.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import slices
from .word_tokens import word_tokenizer

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


class Packer:
    """Pieces are (doc_id, start, doc_tokens, ids); rows come out by take()."""

    def __init__(self, length: int, open_tokens: int, first_sequence: int = 0):
        self.length, self.open_tokens, self.sequence = length, open_tokens, first_sequence
        self.counts = np.zeros(length + 1, np.int64)
        self.levels: dict[int, deque] = defaultdict(deque)  # fill level: windows, each a list of pieces
        self.held, self.rows = 0, []

    def _emit(self, window: list) -> None:
        offset = 0
        for doc_id, start, total, ids in window:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.sequence, offset, ids))
            offset += n
        self.sequence += 1

    def level_for(self, size: int) -> int:
        """The level to fill up from: 0 opens a window. Ties go to the fullest."""
        n, top = self.counts, self.length
        change = np.empty(top - size + 1, np.int64)
        change[0] = 0
        change[1:] = 1 - 2 * n[1 : top - size + 1]
        change[:-1] += 2 * n[size:top] + 1
        change[1:][n[1 : top - size + 1] == 0] = np.iinfo(np.int64).max
        return top - size - int(np.argmin(change[::-1]))

    def add(self, doc_id, ids: bytes) -> None:
        total, width = len(ids) // 4, self.length * 4
        whole = len(ids) // width * width
        for at in range(0, whole, width):
            self._emit([(doc_id, at // 4, total, ids[at : at + width])])
        size = total - whole // 4
        if not size:
            return
        piece = (doc_id, whole // 4, total, ids[whole:])
        level = self.level_for(size)
        if level:
            self.counts[level] -= 1
            window = self.levels[level].popleft()
            self.held -= level
        else:
            window = []
        window.append(piece)
        if level + size == self.length:
            self._emit(window)
            return
        self.counts[level + size] += 1
        self.levels[level + size].append(window)
        self.held += level + size
        if self.held > self.open_tokens:
            self.settle(False)

    def settle(self, last: bool = True) -> None:
        """Empties the open windows: powers of two as they are, the rest cut into full windows."""
        loose: list = []
        for level in sorted(self.levels):
            for window in self.levels[level]:
                if level & (level - 1) == 0 and last:
                    self._emit(window)
                else:
                    loose += window
        self.levels.clear()
        self.counts[:] = 0
        self.held = 0
        window, room = [], self.length
        for piece in loose:
            while piece:
                head, piece = _cut(piece, room)
                window.append(head)
                room -= len(head[3]) // 4
                if not room:
                    self._emit(window)
                    window, room = [], self.length
        if not window:
            return
        fill = self.length - room
        if not last:
            self.counts[fill] += 1
            self.levels[fill].append(window)
            self.held = fill
            return
        for bit in range(fill.bit_length() - 1, -1, -1):
            part, need = [], fill & 1 << bit
            while need:
                head, rest = _cut(window.pop(0), need)
                part.append(head)
                need -= len(head[3]) // 4
                if rest:
                    window.insert(0, rest)
            if part:
                self._emit(part)

    def take(self) -> list:
        rows, self.rows = self.rows, []
        return rows


def _cut(piece, room: int):
    doc_id, start, total, ids = piece
    if len(ids) <= room * 4:
        return piece, None
    return (doc_id, start, total, ids[: room * 4]), (doc_id, start + room, total, ids[room * 4 :])


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, open_tokens: int = 4_000_000, with_ids: bool = True) -> DataFrame:
    """A row per piece, see SCHEMA; ids (little-endian unsigned 32-bit) only if with_ids.

    Needs no shuffle: rows are packed where they are read.
    """
    schema = SCHEMA if with_ids else SCHEMA.removesuffix(", ids binary")
    end = np.array([end_id], "<u4").tobytes()
    kinds = [pa.int64()] * 7 + [pa.binary()]

    def run(batches):
        encode = word_tokenizer(tokenizer_path).encode
        packer = Packer(length, open_tokens, TaskContext.get().partitionId() << 33)

        def batch_of(rows):
            columns = list(zip(*rows))[: 7 + with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for a, b in slices(batch, pa.compute.binary_length(texts).fill_null(0).to_pylist()):
                for doc_id, text in zip(ids[a:b], texts.slice(a, b - a).to_pylist()):
                    packer.add(doc_id, encode(text) + end)
                if rows := packer.take():
                    yield batch_of(rows)
        packer.settle()
        if rows := packer.take():
            yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)
