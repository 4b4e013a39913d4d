"""Removal of word sequences that occur earlier in the corpus, by level-wise doubling.

Only windows that repeat at half the length are extended to the whole length. At the half length a
window is looked at only where it has the smallest hash of all half-length windows inside some
whole window: every whole window holds such an anchor, and equal windows hold it at the same place,
so no repeat is lost while about a sixth of the positions are counted. A whole window then travels
with its anchor, identified by 128 bits (its anchor's hash and its own).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartwright.llm import hashing
from cartwright.llm.common import packed, stored, unpacked

#: Occurrences of one anchor that are compared in one task; more are dealt over salts first.
GROUP_ROWS = 20_000
#: Bytes of a whole window's hash; it is compared only with windows of the same anchor.
WINDOW_BYTES = 8
_LOW = np.uint64(0xFFFFFFFF)


class _Windows:
    """The whole windows of a chunk of texts, each with its anchor."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, length: int):
        starts, ends, self.first = hashing.word_spans(data, bounds)
        counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.words = hashing.hash_words(data, starts, ends)
        half = length // 2
        self.half = hashing.window_hashes(self.words, half)
        n = max(0, len(self.words) - length + 1)
        inside = self.doc[:n] == self.doc[length - 1 :][:n]
        self.start = np.flatnonzero(inside)
        self.anchor = _smallest(self.half, length - half + 1)[inside] if n else self.start
        self.run = np.flatnonzero(np.diff(self.anchor, prepend=-1))  # windows of one anchor follow each other
        # Texts of one doc_id are told apart by a checksum, which stands above the word's number.
        edges = bounds.tolist()
        sums = [zlib.crc32(data[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        self.checksum = np.array(sums, np.uint64) << np.uint64(32)

    def at(self, word: np.ndarray) -> np.ndarray:
        doc = self.doc[word]
        return (self.checksum[doc] | (word - self.first[doc]).astype(np.uint64)).view(np.int64)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each ``width`` values in a row, the leftmost of equal ones."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left = values[:-step] <= values[step:]
        values = np.where(left, values[:-step], values[step:])
        at = np.where(left, at[:-step], at[step:])
        have += step
    return at


def _table(schema: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)],
        names=[name for name, _ in schema],
    )


def _anchors(length: int):
    schema = [("anchor", pa.int64()), ("id", pa.int64()), ("at", pa.int64())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            for low, _, data, bounds in hashing.text_chunks(batch["text"]):
                w = _Windows(data, bounds, length)
                at = w.anchor[w.run]
                if len(at):
                    yield _table(schema, w.half[at].view(np.int64), ids[low + w.doc[at]], w.at(at))

    return find


def _list_rows(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Row number of each list element, and the elements; a null list is empty."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten()


def _extend(length: int):
    """Rows of an anchor that repeats: the hashes of the whole windows it is the anchor of."""
    schema = [
        ("anchor", pa.int64()), ("slot", pa.int64()), ("salts", pa.int64()),
        ("id", pa.int64()), ("at", pa.int64()), ("windows", pa.binary()),
    ]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            row, found = _list_rows(batch["found"])
            found_at = found.field("at").to_numpy().view(np.uint64)
            found_salts = found.field("salts").to_numpy()
            for low, high, data, bounds in hashing.text_chunks(batch["text"]):
                w = _Windows(data, bounds, length)
                mine = slice(*np.searchsorted(row, [low, high]))
                doc, at, salts = row[mine] - low, found_at[mine], found_salts[mine]
                own = (at & ~_LOW) == w.checksum[doc]
                salts_at = np.zeros(len(w.words) + 1, np.int64)
                salts_at[w.first[doc[own]] + (at[own] & _LOW).astype(np.int64)] = salts[own]
                salts = salts_at[w.anchor[w.run]]
                run_end = np.append(w.run[1:], len(w.anchor))
                kept = np.flatnonzero(salts)
                if not len(kept):
                    continue
                sizes = run_end[kept] - w.run[kept]
                inside = np.repeat(salts > 0, run_end - w.run)
                whole = hashing.window_hashes(w.words, length)[w.start[inside]]
                whole = np.ascontiguousarray(whole.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WINDOW_BYTES])
                ends = np.concatenate(([0], np.cumsum(sizes * WINDOW_BYTES)))
                start = w.start[w.run[kept]]
                doc_ids = ids[low + w.doc[start]]
                slots = hashing.mix(doc_ids.view(np.uint64)) % salts[kept].astype(np.uint64)
                blobs = pa.Array.from_buffers(
                    pa.large_binary(), len(kept),
                    [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(whole)],
                ).cast(pa.binary())
                yield _table(
                    schema, w.half[w.anchor[w.run[kept]]].view(np.int64), slots.view(np.int64),
                    salts[kept], doc_ids, w.at(start), blobs,
                )

    return extend


_DECIDED = "anchor long, slot long, id long, at long, mask long, windows binary"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks every window of this task that starts earlier in the task, too.

    A row with windows gives the bits of those that come later (mask). If its anchor is dealt over
    several salts (``salts`` above 1), the row is also passed on, unless all its windows come later:
    the salts' first windows meet in a second round. A row without windows is a mark and passes.
    """
    schema = [
        ("anchor", pa.int64()), ("slot", pa.int64()), ("id", pa.int64()), ("at", pa.int64()),
        ("mask", pa.int64()), ("windows", pa.binary()),
    ]
    waiting = []
    for batch in batches:
        marks = batch.filter(batch["windows"].is_null())
        if marks.num_rows:
            yield _table(schema, *[marks[c] for c, _ in schema])
        batch = batch.filter(batch["windows"].is_valid())
        if batch.num_rows:
            waiting.append(batch)
    if not waiting:
        return
    rows = pa.Table.from_batches(waiting).combine_chunks()
    del waiting
    blobs = rows["windows"].combine_chunks().cast(pa.large_binary())
    bounds = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    bounds = bounds // WINDOW_BYTES
    short = np.frombuffer(blobs.buffers()[2], np.uint8)[: bounds[-1] * WINDOW_BYTES].reshape(-1, WINDOW_BYTES)
    window = np.zeros((bounds[-1] - bounds[0], 8), np.uint8)
    window[:, :WINDOW_BYTES] = short[bounds[0] :]
    window = window.reshape(-1).view("<u8")
    bounds = bounds - bounds[0]
    sizes = np.diff(bounds)
    bit = np.arange(len(window)) - np.repeat(bounds[:-1], sizes)
    anchor, doc, at = (np.repeat(rows[c].to_numpy(), sizes) for c in ("anchor", "id", "at"))
    at = at + bit
    order = np.lexsort((at, doc, anchor, window))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(window[order]) != 0) | (np.diff(anchor[order]) != 0)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.empty(len(order), bool)
    later[order] = (doc[order] != doc[head]) | (at[order] != at[head])
    mask = np.bitwise_or.reduceat(later.astype(np.int64) << bit, bounds[:-1])
    marked = np.flatnonzero(mask)
    columns = {c: rows[c].to_numpy() for c in ("anchor", "id", "at", "salts")}
    if len(marked):
        yield _table(
            schema, columns["anchor"][marked], columns["id"][marked], columns["id"][marked],
            columns["at"][marked], mask[marked], pa.nulls(len(marked), pa.binary()),
        )
    first = np.flatnonzero((columns["salts"] > 1) & (mask != (1 << sizes) - 1))
    if len(first):
        none = np.zeros(len(first), np.int64)
        yield _table(
            schema, columns["anchor"][first], none, columns["id"][first], columns["at"][first],
            none, rows["windows"].combine_chunks().take(pa.array(first)),
        )


def _removed(length: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, marks = _list_rows(batch["marks"])
            at, mask = marks.field("at").to_numpy().view(np.uint64), marks.field("mask").to_numpy()
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            totals, gone, kept = [], [], []
            for i, text in enumerate(batch["text"].cast(pa.binary())):
                text = text.as_py() or b""
                words = text.split()  # bytes split at exactly [\x20\x09-\x0D]
                totals.append(len(words))
                own = slice(edge[i], edge[i + 1])
                covered = _covered(at[own], mask[own], zlib.crc32(text), len(words), length)
                if covered is None:
                    gone.append(0)
                else:
                    gone.append(int(covered.sum()))
                    words = compress(words, ~covered)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["rest"], batch["text"], pa.array(totals, pa.int64()), pa.array(gone, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["rest", "text", "n_words", "n_removed", "kept_text"],
            )

    return remove


def _covered(at, mask, checksum, n_words: int, length: int) -> np.ndarray | None:
    own = (at >> np.uint64(32)) == checksum
    if not own.any():
        return None
    at, mask = (at[own] & _LOW).astype(np.int64), mask[own]
    change = np.zeros(n_words + 1, np.int64)
    for k in range(int(mask.max()).bit_length()):
        starts = at[(mask >> k) & 1 == 1] + k
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = 20, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the kept words, joined by one space).

    Words are runs outside ``[\\x20\\x09-\\x0D]``; a null text has none. A word goes if a window of
    ``length`` words that covers it also starts earlier: in a smaller doc_id, or earlier in the same
    document. Windows are judged on the input.

    Order where doc_id does not say it: a null doc_id comes last, by a hash of the text; texts that share
    a doc_id follow their checksum; equal rows are one document, and each of them loses the same
    words. A text below ``length`` words keeps all. Columns of ``docs`` named like a new one are
    replaced. An empty table gives an empty one.

    Shuffled are: the anchors (about a sixth of all words) once to count and once to pick out the
    repeated ones, the window hashes of those, and the texts once for both joins. Counting combines
    before the shuffle, the join's hot keys can be split, and an anchor with more than ``group_rows``
    occurrences is compared in salts of that size before its first windows meet.
    """
    return unpacked(_judged(docs, length, group_rows), docs.columns, ["n_words", "n_removed", "kept_text"])


def without_repeats(docs: DataFrame, length: int = 20, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` with such words taken out of their texts; every other column is as it was, whatever its name.

    A text that loses nothing stays as it is, null included; one that loses words has its others joined by
    one space, and n_chars, if there is such a column, says its new length. An empty table stays empty.
    """
    judged, changed = _judged(docs, length, group_rows), F.col("n_removed") > 0
    new = {
        "text": lambda own: F.when(changed, F.col("kept_text")).otherwise(own),
        "n_chars": lambda own: F.when(changed, F.length("kept_text").cast("long")).otherwise(own),
    }
    own = {c: F.col("text") if c.lower() == "text" else F.col("rest")[c] for c in docs.columns}
    return judged.select(*[new.get(c.lower(), lambda own: own)(value).alias(c) for c, value in own.items()])


def _judged(docs: DataFrame, length: int, group_rows: int) -> DataFrame:
    """rest and text as in ``packed``, n_words, n_removed and kept_text."""
    if not 4 <= length <= 120:
        raise ValueError("length must be from 4 to 120 words")
    keyed = packed(docs)
    anchors = keyed.select("id", "text").mapInArrow(_anchors(length), "anchor long, id long, at long")
    # Written, so that both sides of the join are plain shuffles, whose hot partitions Spark splits.
    repeated = stored(
        anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("anchor", F.ceil(F.col("n") / group_rows).alias("salts")),
        "repeated",
    )
    found = anchors.join(repeated, "anchor").groupBy("id").agg(
        F.collect_set(F.struct("at", "salts")).alias("found")
    )
    extended = (
        keyed.join(found, "id").select("id", "text", "rest", "found")
        .mapInArrow(_extend(length), "anchor long, slot long, salts long, id long, at long, windows binary")
    )
    by_salt = extended.repartition("anchor", "slot").mapInArrow(_decide, _DECIDED)
    decided = (
        by_salt.withColumn("salts", F.lit(1).cast("long")).repartition("anchor", "slot")
        .mapInArrow(_decide, _DECIDED)
    )
    marks = decided.filter("mask != 0").groupBy("id").agg(
        F.collect_set(F.struct("at", "mask")).alias("marks")
    )
    schema = StructType([keyed.schema["rest"], keyed.schema["text"]])
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_text", "string")):
        schema = schema.add(name, kind)
    return keyed.join(marks, "id", "left").select("rest", "text", "marks").mapInArrow(_removed(length), schema)
