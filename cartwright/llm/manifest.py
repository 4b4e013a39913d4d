"""A Merkle manifest of documents: a tree for each source, one over the sources, a proof for each document.

Leaves are placed by bitmap ranks. Every source has a bitmap of its doc_ids, kept as the 64-bit words
that are not empty, and directories of row counts by ranges of 2**16, 2**32 and 2**48 ids. A leaf's
place is what the directories count before its word, plus the bits below its own in that word; leaves
are never sorted. From then on nodes are keyed by source and place: each block of ``SLOTS`` nodes is a slot
array that is filled by place and reduced by ``LEVELS`` levels in one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from cartwright.llm.common import stored
from cartwright.llm.ranks import ranked

FAN = 3
#: Levels of the tree that one slot array takes, and its slots.
LEVELS = 4
SLOTS = FAN**LEVELS
#: The word of rows without a doc_id: before that of any doc_id.
NO_ID = -(1 << 58)
#: Bits of a word's number (doc_id >> 6) that lie below each directory's ranges.
RANGES = {"container": 10, "region": 26, "zone": 42}


def digest(*fields: Column) -> Column:
    """SHA-256 of fields one after the other, each as byte count, colon and value, or - if null."""
    values = [f.cast("string") for f in fields]
    sized = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*sized), 256))


def _leaves(docs: DataFrame, found: Column) -> DataFrame:
    head = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        # sorts like the source itself, a null one first
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
        F.coalesce(F.shiftright(doc_id, 6), F.lit(NO_ID)).alias("word"),
        F.coalesce(doc_id.bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("bit"),
        digest(*head, F.col("text")).alias("digest"),
        digest(*head, found).alias("found"),
    )


def _directory(words: DataFrame) -> DataFrame:
    """``words`` with the rows of the source before each word (``before``) and in all (``n``).

    A window holds the words of one container, the containers of one region, the regions of one zone or
    the zones of a source: about 2**16 entries at most, whatever the number of documents.
    """
    words = words.withColumns({name: F.shiftright("word", bits) for name, bits in RANGES.items()})
    containers = words.groupBy("key", "zone", "region", "container").agg(F.sum("rows").alias("rows"))
    regions = containers.groupBy("key", "zone", "region").agg(F.sum("rows").alias("rows"))
    zones = regions.groupBy("key", "zone").agg(F.sum("rows").alias("rows"))

    def earlier(entry: str, *group: str) -> Column:
        window = Window.partitionBy("key", *group).orderBy(entry).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("rows").over(window), F.lit(0))

    counted = zones.withColumns({"n": F.sum("rows").over(Window.partitionBy("key")), "before": earlier("zone")})
    for level, group, entry in (
        (regions, "zone", "region"), (containers, "region", "container"), (words, "container", "word")
    ):
        above = counted.select("key", group, "n", F.col("before").alias("start"))
        inside = level.withColumn("inside", earlier(entry, group))
        counted = inside.join(above, ["key", group]).withColumn("before", F.col("start") + F.col("inside"))
    return counted.select("key", "word", "bits", "rows", "before", "n")


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``place``, from 0 on in their source by doc_id, and ``n``, the source's leaves.

    Rows without a doc_id come first, rows with the same one by their digests. Words that hold more rows
    than bits are the only ones whose rows are ranked by sorting.
    """
    bits = F.bit_or(F.expr("shiftleft(1L, bit)"))
    words = stored(leaves.groupBy("key", "word").agg(bits.alias("bits"), F.count(F.lit(1)).alias("rows")), "words")
    directory = _directory(words)
    rank = F.col("before") + F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    own = ["key", "doc_id", "digest", "found", "n"]
    crowded = words.filter("rows > bit_count(bits)").select("key", "word")
    if crowded.isEmpty():
        return leaves.join(directory, ["key", "word"]).select(*own, rank.alias("place"))
    single = leaves.join(directory.filter("rows = bit_count(bits)"), ["key", "word"])
    numbered = leaves.withColumn("tie", F.monotonically_increasing_id())
    sorted_ = ranked(numbered.join(crowded, ["key", "word"], "left_semi"), ["key", "word", "bit", "digest", "found", "tie"])
    first = sorted_.groupBy("key", "word").agg(F.min("rank").alias("first"))
    many = sorted_.join(first.join(directory, ["key", "word"]), ["key", "word"])
    return single.select(*own, rank.alias("place")).unionByName(
        many.select(*own, (F.col("before") + F.col("rank") - F.col("first")).alias("place"))
    )


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], n: int) -> list[list[str]]:
    """The levels of a block from its nodes up; a block that isn't the whole tree always has ``LEVELS`` more."""
    levels = [nodes]
    while len(levels) <= LEVELS if n > SLOTS else len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([_hash("".join(low[i : i + FAN])) for i in range(0, len(low), FAN)])
    return levels


def _filled(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray, list[str]]]:
    """For each block its row, n, its first member, the order of its members by slot, and their digests."""
    slots = batch["slots"]
    members = slots.flatten()
    where = members.field("slot").to_numpy(zero_copy_only=False)
    digests = members.field("digest").to_pylist()
    ends = np.cumsum(slots.value_lengths().to_numpy(zero_copy_only=False))
    for row, (n, end, low) in enumerate(zip(batch["n"].to_pylist(), ends, [0, *ends[:-1]], strict=True)):
        member_of = np.empty(end - low, np.int64)
        member_of[where[low:end]] = np.arange(low, end)
        yield row, n, low, member_of, [digests[m].hex() for m in member_of]


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops = [bytes.fromhex(_levels(nodes, n)[-1][0]) for _, n, _, _, nodes in _filled(batch)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.binary())], names=[*batch.schema.names, "top"])


def _tree(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """Tables of blocks, from the nodes to the roots of all keys.

    ``nodes`` has key, n, place, digest and what the first table also carries for each node.
    """
    levels = []
    while True:
        block, slot = F.expr(f"place div {SLOTS}"), F.expr(f"int(place % {SLOTS})")
        own = [c for c in carried if c in nodes.columns]
        blocks = nodes.groupBy("key", "n", block.alias("block")).agg(
            F.collect_list(F.struct(slot.alias("slot"), "digest", *own)).alias("slots")
        )
        schema = StructType([*blocks.schema.fields, StructField("top", BinaryType())])
        levels.append(stored(blocks.mapInArrow(_reduce, schema), "blocks"))
        if levels[-1].filter(f"n > {SLOTS}").isEmpty():
            return levels
        nodes = levels[-1].select(
            "key", F.expr(f"(n + {SLOTS - 1}) div {SLOTS}").alias("n"), F.col("block").alias("place"),
            F.col("top").alias("digest"),
        )


def _siblings(levels: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """What stands left and right of a node in its run, from its own level up to the block's top."""
    out = []
    for nodes in levels[:-1]:
        run = slot - slot % FAN
        out.append(("".join(nodes[run:slot]), "".join(nodes[slot + 1 : run + FAN])))
        slot //= FAN
    return out


def _above(path: str) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in path.split(";")] if path else []


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of a block's nodes: siblings by level, ``left,right`` each, joined by semicolons."""
    for batch in batches:
        keys, places, paths, subroots = [], [], [], []
        row_keys, blocks, above = (batch[c].to_pylist() for c in ("key", "block", "path"))
        row_subroots, fields = batch["subroot"].to_pylist(), batch["slots"].type.value_type
        children = batch["slots"].flatten().field("child").to_pylist() if fields.get_field_index("child") >= 0 else None
        for row, n, _, member_of, nodes in _filled(batch):
            levels = _levels(nodes, n)
            for slot, member in enumerate(member_of):
                own = ";".join(map(",".join, _siblings(levels, slot)))
                paths.append(";".join(filter(None, (own, above[row]))))
                keys.append(row_keys[row] if children is None else children[member])
                places.append(blocks[row] * SLOTS + slot if children is None else 0)
                subroots.append(row_subroots[row] if children is None else bytes.fromhex(nodes[slot]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(places, pa.int64()), pa.array(paths, pa.string()), pa.array(subroots, pa.binary())],
            names=["key", "place", "path", "subroot"],
        )


def _prove(root: str):
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch["slots"].flatten()
            found = members.field("found").to_pylist()
            order, leaves, proofs, folds, places, rows = [], [], [], [], [], []
            paths, blocks = batch["path"].to_pylist(), batch["block"].to_pylist()
            for row, n, _, member_of, nodes in _filled(batch):
                levels, above = _levels(nodes, n), _above(paths[row])
                upper = "".join(left + right for left, right in above)
                for slot, member in enumerate(member_of):
                    node, proof = found[member].hex(), []
                    for left, right in (own := _siblings(levels, slot)) + above:
                        node = _hash(left + node + right)
                    proof = "".join(left + right for left, right in own) + upper
                    order.append(member)
                    rows.append(row)
                    places.append(blocks[row] * SLOTS + slot)
                    leaves.append(nodes[slot])
                    proofs.append(_hash(proof))
                    folds.append(node)
            yield pa.RecordBatch.from_arrays(
                [
                    members.field("doc_id").take(pa.array(order, pa.int64())),
                    batch["key"].take(pa.array(rows, pa.int64())),
                    pa.array(places, pa.int64()),
                    pa.array(leaves, pa.string()),
                    batch["subroot"].take(pa.array(rows, pa.int64())),
                    pa.array([root] * len(rows), pa.string()),
                    pa.array(proofs, pa.string()),
                    pa.array(folds, pa.string()),
                    pa.array([f == root for f in folds], pa.bool_()),
                ],
                names=["doc_id", "key", "place", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return prove


PROOF = (
    "doc_id long, key string, place long, leaf string, subroot binary, root string, proof_sha256 string,"
    " folded_root string, verified boolean"
)


def audited(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, place, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are the digests of doc_id, source, lang, n_chars and text. ``found`` is the text that a
    document is now found with (its own by default); folded_root is what that text's leaf and the siblings
    of the manifest fold to, verified whether this is root. Nodes are lowercase hex, and a run's node is
    the digest of its children's hex texts.

    Rows without a source are a source of their own, before all others; rows without a doc_id come first
    in their source. Rows with the same doc_id take places in the order of their leaves, so equal rows have
    equal leaves but proofs of their own. Empty and null texts differ. Other columns play no part; an
    empty table gives an empty one.
    """
    leaves = stored(_leaves(docs, F.col("text") if found is None else found), "leaves")
    tree = _tree(placed(leaves), ["doc_id", "found"])
    subroots = ranked(tree[-1].select(F.col("key").alias("child"), F.col("top").alias("digest")), ["child"], "place")
    count = subroots.count()
    nodes = subroots.select(F.lit("").alias("key"), F.lit(count).cast("long").alias("n"), "place", "digest", "child")
    upper = _tree(nodes, ["child"])
    top = upper[-1].select("top").head(1)
    root = top[0]["top"].hex() if top else ""
    no_subroot = F.lit(None).cast("binary").alias("subroot")
    paths = upper[-1].select("key", F.lit(0).cast("long").alias("place"), F.lit("").alias("path"), no_subroot)
    for blocks in [*reversed(upper), *reversed(tree[1:])]:
        joined = blocks.join(paths.withColumnRenamed("place", "block"), ["key", "block"])
        paths = joined.mapInArrow(_descend, "key string, place long, path string, subroot binary")
    joined = tree[0].join(paths.withColumnRenamed("place", "block"), ["key", "block"])
    source = F.when(F.col("key") != "", F.expr("substring(key, 2)"))
    return joined.mapInArrow(_prove(root), PROOF).select(
        "doc_id", source.alias("source"), "place", "leaf", F.lower(F.hex("subroot")).alias("subroot"), "root",
        "proof_sha256", "folded_root", "verified",
    )
