"""Shards of equal bytes through fixed virtual slots and a versioned map from slots to shards.

Every row is hashed into one of ``SLOTS`` virtual slots, for good. Which shard holds a slot is said by a
map, a small table with versions; rebalancing and growing edit the map, and only the rows of edited slots
move. The driver holds a number of bytes and of rows for each slot, so nothing there grows with the table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwright.llm.common import stored
from cartwright.llm.ranks import ranked

SLOTS = 8192
#: Rows that are equal in doc_id, size and checksum are spread in portions of so many.
COPIES = 64
#: Shards may differ by this part of a shard's bytes before slots are moved.
TOLERANCE = 1e-4
RECORD = ["doc_id", "size", "text_crc32"]


@dataclass(frozen=True)
class SlotMap:
    """Version, number of shards, and the shard of every virtual slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def moved(self, before: SlotMap) -> int:
        """Slots that another map holds elsewhere."""
        return sum(a != b for a, b in zip(self.shard_of, before.shard_of, strict=True))


def first_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 0: consecutive slots, as many in each shard."""
    return SlotMap(0, shards, tuple(s * shards // slots for s in range(slots)))


class _Loads:
    """Bytes of each shard and its slots by bytes, while a map is edited."""

    def __init__(self, slot_map: SlotMap, size_of: Sequence[int], shards: int):
        self.shard_of = list(slot_map.shard_of)
        self.bytes = [0] * shards
        self.slots: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        for slot, shard in enumerate(self.shard_of):
            self.bytes[shard] += size_of[slot]
            self.slots[shard].append((size_of[slot], slot))
        for held in self.slots:
            held.sort()

    def move(self, entry: tuple[int, int], source: int, target: int) -> None:
        size, slot = entry
        self.slots[source].remove(entry)
        insort(self.slots[target], entry)
        self.bytes[source] -= size
        self.bytes[target] += size
        self.shard_of[slot] = target

    def nearest(self, shard: int, size: float) -> list[tuple[int, int]]:
        """The shard's slots just below and above a size."""
        held = self.slots[shard]
        at = bisect_left(held, (size,))
        return held[max(0, at - 1) : at + 1]

    def level(self, high: int, low: int) -> bool:
        """Moves a slot from one shard to the other, or exchanges two, so that they differ the least; False
        if every way leaves them no closer."""
        gap = self.bytes[high] - self.bytes[low]
        best, chosen = gap, None
        for entry in self.nearest(high, gap / 2):
            if entry[0] and abs(gap - 2 * entry[0]) < best:
                best, chosen = abs(gap - 2 * entry[0]), (entry, None)
        if best > 2 * gap * TOLERANCE:
            for back in self.slots[low]:
                for entry in self.nearest(high, back[0] + gap / 2):
                    if abs(gap - 2 * (entry[0] - back[0])) < best:
                        best, chosen = abs(gap - 2 * (entry[0] - back[0])), (entry, back)
        if chosen is None:
            return False
        self.move(chosen[0], high, low)
        if chosen[1]:
            self.move(chosen[1], low, high)
        return True


def rebalanced(slot_map: SlotMap, size_of: Sequence[int]) -> SlotMap:
    """The next version: slots moved or exchanged between the fullest and emptiest shards until all are
    within ``TOLERANCE``, or no such edit brings any two shards closer (one slot alone can outweigh a
    shard). Every edit lowers the sum of squared loads, so this ends. Slots that need not move stay.
    """
    loads = _Loads(slot_map, size_of, slot_map.shards)
    allowed = max(1.0, TOLERANCE * sum(size_of) / slot_map.shards)
    while True:
        order = sorted(range(slot_map.shards), key=loads.bytes.__getitem__)
        pairs = sorted(product(order, order), key=lambda p: loads.bytes[p[0]] - loads.bytes[p[1]])
        apart = [(high, low) for low, high in pairs if loads.bytes[high] - loads.bytes[low] > allowed]
        if not any(loads.level(high, low) for high, low in apart):
            return SlotMap(slot_map.version + 1, slot_map.shards, tuple(loads.shard_of))


def grown(slot_map: SlotMap, size_of: Sequence[int]) -> SlotMap:
    """The next version, with one more shard: each shard gives it slots until it holds the new share.

    Slots move into the new shard only.
    """
    shards, new = slot_map.shards + 1, slot_map.shards
    loads = _Loads(slot_map, size_of, shards)
    share = sum(size_of) / shards
    for shard in range(new):
        while (entry := max((e for e in loads.slots[shard] if 0 < e[0] <= loads.bytes[shard] - share), default=None)):
            loads.move(entry, shard, new)
    return SlotMap(slot_map.version + 1, shards, tuple(loads.shard_of))


def saved(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Adds the map to the versions kept at ``path``; writing a version again replaces it."""
    rows = [(slot, shard, slot_map.shards) for slot, shard in enumerate(slot_map.shard_of)]
    table = spark.createDataFrame(rows, "virtual_slot int, shard int, shards int")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={slot_map.version}")


def loaded(spark: SparkSession, path: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{path.rstrip('/')}/version={version}").orderBy("virtual_slot").collect()
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def records(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32; with ``whole`` also all columns as the
    struct ``doc``. A null text has no bytes."""
    text = F.coalesce("text", F.lit(""))
    doc = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole else []
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *doc,
    )


def slotted(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows`` of ``records`` with virtual_slot, a hash of doc_id, size and checksum.

    The slot of a row doesn't depend on other rows, save where more than ``COPIES`` are equal in these three:
    they are numbered and spread over slots in portions, so that no slot is as hot as a row is frequent.
    """
    slot = lambda *portion: F.pmod(F.xxhash64(*RECORD, *portion), F.lit(slots)).cast("int").alias("virtual_slot")
    hot = stored(rows.groupBy(*RECORD).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > COPIES).drop("rows"), "hot-records")
    if hot.isEmpty():
        return rows.select("*", slot())
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in RECORD]
    tied = rows.withColumn("tie", F.monotonically_increasing_id()).alias("r")
    many = ranked(tied.join(hot.alias("h"), same, "left_semi"), [*RECORD, "tie"])
    return rows.alias("r").join(hot.alias("h"), same, "left_anti").select("*", slot()).unionByName(
        many.select(*rows.columns, slot(F.expr(f"rank div {COPIES}")))
    )


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every virtual slot."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    held = {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in sums}
    both = [held.get(s, (0, 0)) for s in range(slots)]
    return [b for b, _ in both], [r for _, r in both]


def placed(rows: DataFrame, slot_map: SlotMap, rows_of: Sequence[int]) -> DataFrame:
    """``rows`` with shard and slot, the place in it: slots in order, and rows in a slot by doc_id.

    The rows before a slot are counted from ``rows_of``, so only the rows of one virtual slot meet. The
    map has one row for each virtual slot, which bounds what is broadcast.
    """
    held, entries = [0] * slot_map.shards, []
    for slot, (shard, n) in enumerate(zip(slot_map.shard_of, rows_of, strict=True)):
        entries.append((slot, shard, held[shard]))
        held[shard] += n
    table = rows.sparkSession.createDataFrame(entries, "virtual_slot int, shard int, rows_before long")
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*RECORD)) - 1
    return (
        rows.withColumn("inside", inside).join(F.broadcast(table), "virtual_slot")
        .withColumn("slot", F.col("rows_before") + F.col("inside")).drop("rows_before", "inside")
    )


def sharded(docs: DataFrame, shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    The law is ``bytes``: shards hold nearly equal sums of size. Version 0 of the map goes to ``path``,
    then version 1, edited for the bytes that the slots turned out to hold. slot is the row's place in its
    shard, from 0 on. grown_shard is null: how many rows a new shard takes depends on bytes, not on ids alone (``grown``).
    Null, repeated and empty rows are rows like others; other columns play no part; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = stored(slotted(records(docs), slots), "slots")
    size_of, rows_of = slot_sizes(rows, slots)
    start = first_map(shards, slots)
    saved(spark, start, path)
    saved(spark, rebalanced(start, size_of), path)
    current = loaded(spark, path, start.version + 1)
    no_shard: Column = F.lit(None).cast("int")
    return placed(rows, current, rows_of).select(
        *RECORD, F.lit("bytes").alias("law"), "shard", "slot", no_shard.alias("grown_shard"),
        "virtual_slot", F.lit(current.version).alias("map_version"),
    )


def write_shards(docs: DataFrame, slot_map: SlotMap, path: str, slots: int = SLOTS) -> None:
    """Whole documents as Parquet, a folder ``shard=N`` for each shard; own columns as they are.

    A shard's rows are written by many tasks, dealt by virtual slot.
    """
    rows = slotted(records(docs, whole=True), slots).repartition("virtual_slot")
    table = docs.sparkSession.createDataFrame(enumerate(slot_map.shard_of), "virtual_slot int, shard int")
    placed_docs = rows.join(F.broadcast(table), "virtual_slot").select("doc", "virtual_slot", "shard")
    placed_docs.write.mode("overwrite").partitionBy("shard").parquet(path)
