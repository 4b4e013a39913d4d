"""Packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.llm import tokens

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)
OUT_BYTES = 1 << 22
#: Sequence numbers of one task; the task's number stands above them.
TASK_BITS = 40


class SumOfSquares:
    """Windows of one task that still have room, by fill level.

    ``level[h]`` counts the windows filled to ``h``. A piece goes to the level whose use leaves the
    smallest sum of squared counts, or opens a window if that is smallest.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(capacity)]

    def place(self, piece: tuple, size: int) -> list | None:
        """Puts a piece shorter than a window in one; returns the window if that is now full."""
        level, capacity = self.level, self.capacity
        best, at = 2 * level[size] + 1, 0
        if level[capacity - size] and 1 - 2 * level[capacity - size] <= best:
            best, at = 1 - 2 * level[capacity - size], capacity - size
        here = level[1 : capacity - size]
        if len(here):
            change = np.where(here > 0, 2 * (level[size + 1 : capacity] - here + 1), best + 1)
            h = len(change) - 1 - int(change[::-1].argmin())
            if change[h] < best:
                at = h + 1
        window = self.windows[at].pop() if at else []
        window.append(piece)
        level[at] -= at > 0
        if at + size == capacity:
            return window
        level[at + size] += 1
        self.windows[at + size].append(window)
        return None

    def close(self) -> Iterator[list]:
        """The windows left at the end: the emptiest are poured into the room of the fullest."""
        left = [(h, w) for h in range(1, self.capacity) for w in self.windows[h]]
        giver, taker = 0, len(left) - 1
        room = self.capacity - left[taker][0] if left else 0
        while giver < taker:
            window = left[giver][1]
            while window and giver < taker:
                doc, start, end = window.pop()
                taken = min(room, end - start)
                left[taker][1].append((doc, start, start + taken))
                room -= taken
                if start + taken < end:
                    window.append((doc, start + taken, end))
                if room == 0:
                    yield left[taker][1]
                    taker -= 1
                    room = self.capacity - left[taker][0]
            giver += not window
        if left and left[taker][1]:
            yield left[taker][1]


def _packer(path: str, capacity: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path, "ids")
        first = TaskContext.get().partitionId() << TASK_BITS
        schema = pa.schema(
            [(c, pa.binary() if c == "ids" else pa.int64()) for c in SCHEMA.replace(",", "").split()[::2]]
        )
        packing = SumOfSquares(capacity)
        docs: dict[int, list] = {}  # number -> doc_id, ids, tokens not written yet
        rows: list[tuple] = []
        size = sequences = read = 0

        def write(window: list) -> int:
            nonlocal sequences
            offset = written = 0
            for doc, start, stop in window:
                doc_id, ids, left = docs[doc]
                piece = ids[4 * start : 4 * stop]
                rows.append(
                    (doc_id, start, stop - start, piece, len(ids) // 4, first + sequences, offset)
                )
                offset += stop - start
                written += len(piece)
                docs[doc][2] = left - (stop - start)
                if not docs[doc][2]:
                    del docs[doc]
            sequences += 1
            return written

        def taken() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                schema=schema,
            )
            rows.clear()
            return batch

        for batch in batches:
            texts = (x.as_py() for x in batch["text"])
            for doc_id, pieces in zip(batch["doc_id"].to_pylist(), encoder.texts(texts), strict=True):
                ids = b"".join([b"".join(p) for p in pieces]) + end
                n = len(ids) // 4
                docs[read] = [doc_id, ids, n]
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    size += write([(read, start, start + capacity)])
                if whole < n and (full := packing.place((read, whole, n), n - whole)):
                    size += write(full)
                read += 1
                if size >= OUT_BYTES:
                    yield taken()
                    size = 0
        for window in packing.close():
            size += write(window)
            if size >= OUT_BYTES:
                yield taken()
                size = 0
        if rows:
            yield taken()

    return pack


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Documents as pieces of sequences of at most ``capacity`` tokens.

    A document is its text's ids by the vocabulary file at ``path``, then ``end_id``; a null or
    empty text is the end id alone. Whole windows of a document are sequences of their own, the rest
    goes online to the fill level that leaves the smallest sum of squared level counts. What a task
    has open at its end is poured together, cutting pieces, so a task pads one sequence at most. Each
    task packs its own documents: no shuffle, and a lost task packs the same way again.

    Returns a row per piece: doc_id, start (its document's ids before it), length, ids (little-endian
    unsigned 32 bits), doc_tokens (of the document, with the end id), sequence_id and offset in it.
    Other columns of ``docs`` are left out. Rows with the same or a null doc_id are separate documents.
    An empty table gives no pieces.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _packer(path, capacity, end_id), SCHEMA
    )
