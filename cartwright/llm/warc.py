"""WARC archives of pages, and their fixity audit by Merkle trees over two replicas."""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.llm.common import stored, work_folder

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Records or nodes under one node of the next level.
FAN_OUT = 16
_LENGTH = re.compile(rb"^content-length:\s*(\d+)\s*$", re.I | re.M)
_PAGE = re.compile(rb"^warc-record-id:\s*<urn:page:(-?\d+)>\s*$", re.I | re.M)
HEAD_BYTES = 1 << 16
#: What stands behind the gzip member of a record: a member without content.
GAP = gzip.compress(b"", mtime=0)
#: The start of a record's member: gzip's magic, a field of its own with the record's number and offset, and
#: a check sum of these.
_START = b"\x1f\x8b\x08\x06\x00\x00\x00\x00\x00\xff\x14\x00CW\x10\x00"
_PLACE = struct.Struct("<QQ")
_WHOLE = len(_START) + _PLACE.size + 2

_NODE = "file string, level int, number long, start long, stop long, hash binary, page_id long, damaged boolean"


def record(date: Column | str = DATE) -> Column:
    """A page (page_id, url, html) as a WARC record without its closing blank lines.

    A null url or html is empty; a null page_id leaves the record id without a number. Line ends in a
    url are percent-encoded, so they can't end a header.
    """
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    html = F.coalesce("html", F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: "), F.lit(date) if isinstance(date, str) else date,
        F.lit("\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nWARC-Payload-Digest: sha256:"), F.sha2(html, 256),
        F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(END), html,
    )


def write_archive(pages: DataFrame, folder: str, value: Column | None = None) -> str:
    """Writes one WARC file per partition of ``pages``, a gzip member per record; returns the folder.

    A record ends in the two line ends that the format asks for. Its member's header holds the record's
    number and offset in the file, so that what stands behind damage is still known by its place. Members
    without content stand in as the text sink's line separator. The file name starts with the number of
    the partition, so two archives of the same partitions name their files alike.
    """
    rows = pages.select((record() if value is None else value).cast("binary").alias("value"))
    members = rows.mapInArrow(_members_of, "value binary").select(F.col("value").cast("string").alias("value"))
    sink = members.write.option("lineSep", GAP.decode("latin-1")).option("encoding", "ISO-8859-1")
    sink.option("compression", "none").option("maxRecordsPerFile", 0).text(folder)
    return folder


def _members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = offset = 0
    for batch in batches:
        members = []
        for value in batch["value"]:
            data = value.as_py() + END.encode()
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            head = _START + _PLACE.pack(number, offset)
            members.append(b"".join((
                head, (zlib.crc32(head) & 0xFFFF).to_bytes(2, "little"), packer.compress(data), packer.flush(),
                struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF),
            )))
            number, offset = number + 1, offset + len(data)
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["value"])


class _Member:
    """The content of the gzip member at ``at`` of ``data``; ``broken`` if it can't be read to its end."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at, self.broken = data, at, False
        self.unpacker = zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        while not (self.broken or self.unpacker.eof):
            fed = self.unpacker.unconsumed_tail
            if not fed:
                fed = self.data[self.at : self.at + HEAD_BYTES]
                self.at += len(fed)
            try:
                out = self.unpacker.decompress(fed, n)
            except zlib.error:
                self.broken = True
                break
            if self.unpacker.eof:
                self.at -= len(self.unpacker.unused_data)
            if out:
                return out
            self.broken = not len(fed) and not self.unpacker.eof
        return b""


def _place(raw: bytes, at: int) -> tuple[int, int] | None:
    """Number and offset of the record whose member starts at ``at``; None if its header is no such one."""
    head = raw[at : at + _WHOLE]
    if len(head) < _WHOLE or not head.startswith(_START) or (zlib.crc32(head[:-2]) & 0xFFFF).to_bytes(2, "little") != head[-2:]:
        return None
    return _PLACE.unpack_from(head, len(_START))


def _leaves(raw: bytes) -> list[tuple[int, int, bytes, int | None, bool]]:
    """(start, stop, hash, page id, damaged) of the records of a stored file, in order.

    Offsets and hashes are of the uncompressed records. Where members tell their place, a record is a
    member, whatever its content says. A stored range that can't be read ends at the next such member; each
    record that belongs there is damaged, with a hash of the stored bytes. A file without such members is
    cut by the heads of its records and read up to its first damage, the last record being damaged then.
    """
    leaves: list[tuple[int, int, bytes, int | None, bool]] = []
    view, at, offset = memoryview(raw), 0, 0

    def spoiled(start: int, stop: int, stored: bytes) -> tuple:
        return start, stop, sha256(stored + len(leaves).to_bytes(8, "big")).digest(), None, True

    def blame(stored: bytes) -> None:
        start, stop, digest, page, _ = leaves[-1]
        leaves[-1] = (start, stop, sha256(digest + stored).digest(), page, True)

    if _START not in raw:
        while at < len(raw):
            member, begun = _Member(view, at), offset
            for start, size, digest, page in _records(member):
                offset = begun + start + size
                leaves.append((begun + start, offset, digest, page, False))
            if member.broken:
                if offset > begun:
                    blame(raw[at:])
                else:
                    leaves.append(spoiled(offset, offset, raw[at:]))
                break
            at = member.at
            while at < len(raw) and raw[at] == 0:
                at += 1
        return leaves

    bad, behind = None, False
    while 0 <= at < len(raw):
        place, found = _place(raw, at), False
        if place and place[0] >= len(leaves):
            number, start = place
            if bad is not None and number == len(leaves) and leaves:
                blame(raw[bad:at])
            while len(leaves) < number:
                leaves.append(spoiled(offset, start, raw[at if bad is None else bad : at]))
            bad, offset, member = None, start, _Member(view, at)
            data = b"".join(iter(lambda: member.read(1 << 24), b""))
            if not member.broken:
                page, found = _PAGE.search(data[: data.find(END.encode()) + 2]), True
                offset = start + len(data)
                leaves.append((start, offset, sha256(data).digest(), int(page[1]) if page else None, False))
                at = member.at
                if raw.startswith(GAP, at):
                    at += len(GAP)
                    continue
        if bad is None:
            bad, behind = at, found
        at = raw.find(_START, at if found else at + 1)
    if bad is not None and not (behind and len(raw) - bad <= len(GAP)):
        leaves.append(spoiled(offset, offset, raw[bad:]))
    elif bad is not None and bad < len(raw):
        blame(raw[bad:])
    return leaves


def _records(stream: _Member) -> Iterator[tuple[int, int, bytes, int | None]]:
    """(offset, length, digest, page id) of the records of an uncompressed file, in order.

    A record is its head, the length that the head states, and the end mark. Where the head is broken
    or the end mark is not where it should be, the rest of the file is one record without a page.
    """
    data, offset = stream.read(HEAD_BYTES), 0
    while data:
        while len(data) < 5 and (more := stream.read(HEAD_BYTES)):
            data += more
        head = data.find(b"\r\n\r\n")
        if head < 0 and data.startswith(b"WARC/"):
            whole = bytearray(data)
            while head < 0 and (more := stream.read(HEAD_BYTES)):
                whole += more
                head = whole.find(b"\r\n\r\n", len(whole) - len(more) - 3)
            data = bytes(whole)
        found = _LENGTH.search(data[: head + 2]) if head >= 0 and data.startswith(b"WARC/") else None
        size = head + 8 + int(found[1]) if found else 0
        while found and len(data) < size and (more := stream.read(max(HEAD_BYTES, size - len(data)))):
            data += more
        page = _PAGE.search(data[: head + 2]) if found else None
        if not found or data[size - 4 : size] != b"\r\n\r\n":
            digest, size = sha256(data), len(data)
            while more := stream.read(HEAD_BYTES):
                digest.update(more)
                size += len(more)
            yield offset, size, digest.digest(), None
            return
        yield offset, size, sha256(memoryview(data)[:size]).digest(), int(page[1]) if page else None
        data, offset = data[size:] or stream.read(HEAD_BYTES), offset + size


def _trees(fan_out: int):
    schema = pa.schema([
        ("file", pa.string()), ("level", pa.int32()), ("number", pa.int64()), ("start", pa.int64()),
        ("stop", pa.int64()), ("hash", pa.binary()), ("page_id", pa.int64()), ("damaged", pa.bool_()),
    ])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name = re.search(r"part-\d+", path.as_py().rsplit("/", 1)[-1])
                name = name[0] if name else path.as_py().rsplit("/", 1)[-1]
                nodes = _leaves(content.as_py())
                level = 0
                while nodes:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(nodes)), pa.array([level] * len(nodes), pa.int32()),
                            pa.array(range(len(nodes)), pa.int64()),
                            *[pa.array([n[i] for n in nodes], schema.field(3 + i).type) for i in range(5)],
                        ],
                        schema=schema,
                    )
                    if len(nodes) == 1:
                        break
                    nodes = [_parent(nodes[i : i + fan_out]) for i in range(0, len(nodes), fan_out)]
                    level += 1

    return build


def _parent(children: list[tuple]) -> tuple:
    """A node over an ordered range of offsets: the hash covers each child's range and hash."""
    whole = sha256()
    for start, stop, digest, *_ in children:
        whole.update(start.to_bytes(8, "big") + stop.to_bytes(8, "big") + digest)
    return children[0][0], children[-1][1], whole.digest(), None, any(child[4] for child in children)


def merkle_nodes(spark: SparkSession, folder: str, fan_out: int = FAN_OUT) -> DataFrame:
    """The tree of each file of an archive: file, level, number, start, stop, hash, page_id, damaged.

    Level 0 are the records; a node of a higher level covers ``fan_out`` neighbours. The highest
    level of a file is its root. A file is read by one task; an empty one has no nodes.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_trees(fan_out), _NODE)


def _roots(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("file").agg(F.max_by(F.struct("level", "stop", "hash"), "level").alias("root"))


def archive_root(nodes: DataFrame, fan_out: int = FAN_OUT) -> str | None:
    """Hash over the file roots in the order of file names, level by level; None without files."""
    level = _roots(nodes).select(
        F.sha2(F.concat_ws(" ", "file", F.col("root.stop"), F.hex("root.hash")), 256).alias("hash"),
        (F.regexp_extract("file", r"\d+", 0).cast("long")).alias("number"),
    )
    while True:
        some = level.limit(2).collect()
        if len(some) < 2:
            return some[0]["hash"] if some else None
        level = stored(
            level.groupBy(F.expr(f"number div {fan_out}").alias("number")).agg(
                F.sha2(F.array_join(F.transform(
                    F.sort_array(F.collect_list(F.struct("number", "hash"))), lambda x: x["hash"]
                ), " "), 256).alias("hash")
            ),
            "roots",
        )


def damaged_records(first: DataFrame, second: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Records that differ between two replicas' nodes: file, number, found (damaged, changed, moved,
    missing or added, seen from the first replica).

    Equal archive roots end the audit. Else the roots of the files are compared, and under each node
    that differs its children, level by level: other branches are not looked at. A file whose trees
    differ in height is compared record by record. ``moved`` is an unchanged record at other offsets, ``damaged`` one whose stored range
    can't be read in one of the replicas.
    """
    spark = first.sparkSession
    columns = "file string, number long, found string"
    if archive_root(first, fan_out) == archive_root(second, fan_out):
        return spark.createDataFrame([], columns)
    tops = [
        _roots(n).select("file", F.col("root.level").alias(f"top_{x}"), F.col("root").alias(f"root_{x}"))
        for n, x in ((first, "a"), (second, "b"))
    ]
    files = stored(
        tops[0].join(tops[1], "file", "full").filter(~F.col("root_a").eqNullSafe(F.col("root_b"))).select(
            "file", F.when(F.col("top_a") == F.col("top_b"), F.col("top_a")).otherwise(0).alias("top"),
        ),
        "files",
    )
    highest = files.agg(F.max("top")).first()[0]
    open_nodes = None
    for level in range(highest or 0, -1, -1):
        begun = files.filter(F.col("top") == level).select("file")
        sides = []
        for nodes in (first, second):
            here = nodes.filter(F.col("level") == level)
            part = here.join(begun, "file", "left_semi")
            if open_nodes is not None:
                under = here.withColumn("parent", F.expr(f"number div {fan_out}"))
                part = part.unionByName(
                    under.join(open_nodes, ["file", "parent"], "left_semi").drop("parent")
                )
            sides.append(part)
        a = sides[0].select("file", "number", F.struct("start", "stop").alias("range_a"), F.col("hash").alias("hash_a"), F.col("damaged").alias("damaged_a"))
        b = sides[1].select("file", "number", F.struct("start", "stop").alias("range_b"), F.col("hash").alias("hash_b"), F.col("damaged").alias("damaged_b"))
        same = F.col("hash_a").eqNullSafe(F.col("hash_b")) & F.col("range_a").eqNullSafe(F.col("range_b"))
        differ = stored(a.join(b, ["file", "number"], "full").filter(~same), "differing")
        open_nodes = differ.select("file", F.col("number").alias("parent"))
    found = (
        F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "added")
        .when(F.col("damaged_a") | F.col("damaged_b"), "damaged").when(F.col("hash_a") != F.col("hash_b"), "changed").otherwise("moved")
    )
    return differ.select("file", "number", found.alias("found"))


def audit(spark: SparkSession, first: str, second: str, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per record of either replica: page_id, file, number, start, length, sha256, found.

    ``found`` is intact, or what ``damaged_records`` says; page_id, place and hash are the first
    replica's, and the second's where the first has no such record.
    """
    a, b = (stored(merkle_nodes(spark, folder, fan_out), "nodes") for folder in (first, second))
    damage = damaged_records(a, b, fan_out)
    record_of = [
        n.filter("level = 0").select("page_id", "file", "number", "start", F.expr("stop - start").alias("length"), F.lower(F.hex("hash")).alias("sha256"), "damaged")
        for n in (a, b)
    ]
    added = record_of[1].join(damage.filter("found = 'added'"), ["file", "number"])
    known = record_of[0].join(damage, ["file", "number"], "left").withColumn("found", F.coalesce("found", F.when(F.col("damaged"), "damaged"), F.lit("intact")))
    order = ["page_id", "file", "number", "start", "length", "sha256", "found"]
    return known.select(*order).unionByName(added.select(*order))


def audited_pages(pages: DataFrame, damage: Column | None = None) -> DataFrame:
    """``pages`` (page_id, url, html) written as two replicas, and the audit of the second.

    ``damage`` chooses rows whose record gets another date in the second replica. Null columns,
    empty and very long pages, repeated rows and other columns are all fine: a row is a record. An
    empty table gives an empty one.
    """
    folder = f"{work_folder(pages.sparkSession)}/warc-{uuid4().hex}"
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    other = None
    if damage is not None:
        other = record(F.when(damage, F.lit(DATE.replace("00Z", "01Z"))).otherwise(F.lit(DATE)))
    return audit(
        pages.sparkSession, write_archive(whole, f"{folder}/a"), write_archive(whole, f"{folder}/b", other)
    )
