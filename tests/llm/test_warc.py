"""WARC files and the audit of two replicas."""

import gzip
import re
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cartwright.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{'é' * (i % 40)}</p>\r\n\r\nWARC/1.1") for i in range(700)]
    rows += [(None, None, None), (3, "a\r\nb", ""), (3, "a\r\nb", ""), (701, "long", "x" * 400_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    return df.withColumn("file", F.lit("own")).withColumn("hash", F.lit("own"))


def files(folder):
    from pathlib import Path

    return {p.name: gzip.decompress(p.read_bytes()) for p in sorted(Path(folder).glob("part-*"))}


def test_files_hold_every_page(spark, pages, tmp_path):
    warc.write_archive(pages.repartition(3), str(tmp_path / "a"))
    whole = b"".join(files(tmp_path / "a").values())
    nodes = warc.merkle_nodes(spark, str(tmp_path / "a"))
    leaves = nodes.filter("level = 0").collect()
    assert len(leaves) == pages.count() and sum(r.stop - r.start for r in leaves) == len(whole)
    assert Counter(r.page_id for r in leaves) == Counter(r.page_id for r in pages.collect())
    by_name = {re.match(r"part-\d+", k)[0]: v for k, v in files(tmp_path / "a").items()}
    assert all(sha256(by_name[r.file][r.start : r.stop]).digest() == bytes(r.hash) for r in leaves)


def test_equal_replicas_are_intact(pages, nothing):
    found = warc.audited_pages(pages).collect()
    assert len(found) == pages.count() and {r.found for r in found} == {"intact"}
    assert warc.audited_pages(pages.filter("false")).count() == 0


def test_planted_damage_is_located(pages):
    damage = (F.col("page_id") % 97 == 5) | F.col("page_id").isNull()
    found = warc.audited_pages(pages, damage).collect()
    changed = {r.page_id for r in found if r.found == "changed"}
    assert changed == {i for i in range(700) if i % 97 == 5} | {None}
    assert Counter(r.found for r in found)["intact"] == pages.count() - len(changed)


def copied(spark, pages, tmp_path, edit):
    warc.write_archive(pages, str(tmp_path / "a"))
    (tmp_path / "b").mkdir()
    for name, data in files(tmp_path / "a").items():
        (tmp_path / "b" / name).write_bytes(gzip.compress(edit(data)))
    return warc.audit(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()


def test_a_longer_record_moves_the_later_ones(spark, pages, tmp_path):
    def edit(data):
        at = data.index(b"<urn:page:200>")
        return data[:at] + data[at:].replace(b"http://h/200", b"http://h/2000", 1)

    found = {(r.page_id, r.number): r.found for r in copied(spark, pages, tmp_path, edit)}
    assert all(found[i, i] == "intact" for i in range(200)) and found[200, 200] == "changed"
    assert all(found[i, i] == "moved" for i in range(201, 700))


def test_a_cut_file_misses_its_end(spark, pages, tmp_path):
    found = copied(spark, pages, tmp_path, lambda data: data[: data.index(b"<urn:page:650>")])
    kinds = Counter(r.found for r in found)
    assert kinds["intact"] == 650 and kinds["changed"] == 1 and kinds["missing"] == pages.count() - 651


def test_a_broken_head_ends_the_file(spark, pages, tmp_path):
    found = copied(spark, pages, tmp_path, lambda data: data.replace(b"WARC/1.1\r\nWARC-Type", b"XARC/1.1\r\nWARC-Type", 1))
    assert Counter(r.found for r in found) == {"changed": 1, "missing": pages.count() - 1}


def test_a_lost_file_is_missing(spark, pages, tmp_path):
    warc.write_archive(pages.repartition(2), str(tmp_path / "a"))
    (tmp_path / "b").mkdir()
    (name, data), (_, other) = files(tmp_path / "a").items()
    (tmp_path / "b" / name).write_bytes(gzip.compress(data))
    found = warc.audit(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()
    assert {r.found for r in found if r.file == "part-00000"} == {"intact"}
    assert {r.found for r in found if r.file == "part-00001"} == {"missing"}
    back = warc.audit(spark, str(tmp_path / "b"), str(tmp_path / "a")).collect()
    assert {r.found for r in back if r.file == "part-00001"} == {"added"}


def test_only_differing_branches_are_open(spark, pages, tmp_path):
    nodes = [
        warc.merkle_nodes(spark, warc.write_archive(pages, str(tmp_path / x), value), 4)
        for x, value in (("a", None), ("b", warc.record(F.when(F.col("page_id") == 9, F.lit("x" * 20)).otherwise(F.lit(warc.DATE)))))
    ]
    found = warc.damaged_records(*nodes, fan_out=4).collect()
    assert [(r.number, r.found) for r in found] == [(9, "changed")]
    assert warc.archive_root(nodes[0], 4) != warc.archive_root(nodes[1], 4)


def stored_copy(spark, pages, tmp_path, edit):
    """The audit of a replica whose stored bytes ``edit`` changes, given the starts of the members."""
    warc.write_archive(pages, str(tmp_path / "a"))
    (tmp_path / "b").mkdir()
    (path,) = (tmp_path / "a").glob("part-*")
    data = bytearray(path.read_bytes())
    starts = [m.start() for m in re.finditer(re.escape(warc._START), data)]
    assert len(starts) == pages.count()
    (tmp_path / "b" / path.name).write_bytes(edit(data, starts) or data)
    return {r.number: (r.found, r.page_id) for r in warc.audit(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}


def test_flipped_bytes_are_located(spark, pages, tmp_path):
    def edit(data, starts):
        for n, at in ((0, 1), (20, 22), (30, 60), (300, 200)):  # magic, place, content
            data[starts[n] + at] ^= 4
        data[starts[50] - 24] ^= 1  # length of record 49
        data[starts[61] - 15] ^= 1  # time in the member behind record 60
        data[starts[100] : starts[103] - 30] = b"z" * (starts[103] - 30 - starts[100])

    found = stored_copy(spark, pages, tmp_path, edit)
    damaged = {0, 20, 30, 300, 49, 60, 100, 101, 102}
    assert {n for n, (kind, _) in found.items() if kind == "damaged"} == damaged
    assert {kind for n, (kind, _) in found.items() if n not in damaged} == {"intact"} and len(found) == pages.count()
    assert all(found[n][1] == n for n in damaged)


def test_a_file_cut_in_storage(spark, pages, tmp_path):
    found = stored_copy(spark, pages, tmp_path, lambda data, starts: data[: starts[500] + 70])
    assert Counter(kind for kind, _ in found.values()) == {"intact": 500, "damaged": 1, "missing": pages.count() - 501}
    assert found[500] == ("damaged", 500)


def test_a_wrong_length_in_a_member_is_one_record(spark, pages, tmp_path):
    def edit(data, starts):
        start, stop = starts[7], starts[8] - len(warc.GAP)
        whole = gzip.decompress(data[start:stop])
        wrong = whole.replace(b"Content-Length: ", b"Content-Length: 9", 1)
        packed = gzip.compress(wrong)[10:]
        return data[: start + warc._WHOLE] + packed + data[stop:]

    found = stored_copy(spark, pages, tmp_path, edit)
    assert found[7] == ("changed", 7) and Counter(kind for kind, _ in found.values())["intact"] == pages.count() - 1


def test_a_flip_in_one_stream_does_not_end_the_audit(spark, pages, tmp_path):
    warc.write_archive(pages, str(tmp_path / "a"))
    (tmp_path / "b").mkdir()
    for name, data in files(tmp_path / "a").items():
        packed = bytearray(gzip.compress(data, 0))
        packed[len(packed) // 2] ^= 1
        (tmp_path / "b" / name).write_bytes(packed[:-9])
    kinds = Counter(r.found for r in warc.audit(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect())
    assert kinds["intact"] > 600 and sum(kinds.values()) == pages.count()


def test_a_head_of_any_length(spark, tmp_path):
    rows = [(1, "u", "a"), (2, "u" * 3_000_000, "b"), (3, "u", "c")]
    long = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    found = copied(spark, long, tmp_path, lambda data: data)
    assert sorted((r.page_id, r.found) for r in found) == [(n, "intact") for n in (1, 2, 3)]
    leaves = warc.merkle_nodes(spark, str(tmp_path / "b")).filter("level = 0").collect()
    assert sorted(r.page_id for r in leaves) == [1, 2, 3]
