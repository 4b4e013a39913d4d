"""Token counts, packing and piece encodings against the libraries and exact round trips."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cartwright.llm import packing, pieces, token_counts, tokens

SF_DIR = "/root/testdata/sf0.001"


def library_ids(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(spark, byte_bpe):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = token_counts.count_tokens(docs, byte_bpe).collect()
    expected = library_ids(byte_bpe, [r.text for r in found])
    assert [r.n_tokens for r in found] == [len(x) for x in expected]
    assert all(r.n_bytes == len(r.text.encode()) and r.over_limit == (r.n_tokens > 1024) for r in found)


def test_counts_of_odd_rows(odd, odd_rows, nothing, byte_bpe):
    found = token_counts.count_tokens(odd, byte_bpe).collect()
    expected = library_ids(byte_bpe, [r.text or "" for r in found])
    assert [r.n_tokens for r in found] == [len(x) for x in expected] and len(found) == len(odd_rows)
    assert found[0].ids == "own ids" and token_counts.count_tokens(nothing, byte_bpe).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\xa0\x1cab'ést,1é日<|endoftext|>"), max_size=40), max_size=4))
def test_units_equal_whole_texts(texts):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = [
        np.frombuffer(b"".join(b"".join(p) for p in ps), "<u4").tolist()
        for ps in tokens.encoder(path, "ids").texts(iter(texts))
    ]
    assert found == library_ids(path, texts)


def test_long_texts_are_cut_at_safe_spaces():
    text = "ab  cd\n" * 50 + "word " * 400
    cut = list(tokens.safe_pieces(text, 100))
    assert len(cut) > 10 and cut[0][1] + "".join((" " if s else "") + p for s, p in cut[1:]) == text
    assert list(tokens.safe_pieces("x" * 500, 100)) == [(False, "x" * 500)]


def check_pieces(rows, expected, capacity):
    """Every id in one piece, offsets without gaps, no sequence beyond the capacity."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    joined = []
    for own in by_doc.values():
        docs = defaultdict(list)
        for r in own:
            docs[r.doc_tokens].append(r)
        joined += [b"".join(r.ids for r in sorted(d, key=lambda r: r.start)) for d in docs.values()]
    assert sorted(joined) == sorted(np.array(x, "<u4").tobytes() for x in expected)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length and r.length > 0
            at += r.length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize(("capacity", "parts"), [(2048, 1), (64, 3)])
def test_packing_loses_no_id(spark, byte_bpe, capacity, parts):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(parts)
    rows = packing.pack(docs, byte_bpe, capacity).collect()
    expected = [x + [1] for x in library_ids(byte_bpe, [r.text for r in docs.select("text").collect()])]
    sequences = check_pieces(rows, expected, capacity)
    assert sequences * capacity - sum(map(len, expected)) < parts * capacity


def test_packing_odd_rows(odd, odd_rows, nothing, byte_bpe):
    rows = packing.pack(odd, byte_bpe).collect()
    expected = library_ids(byte_bpe, [t or "" for _, t, *_ in odd_rows])
    assert sum(r.length for r in rows) == sum(len(x) + 1 for x in expected)
    assert packing.pack(nothing, byte_bpe).count() == 0


def test_placement_has_the_smallest_sum_of_squares():
    rng = random.Random(2)
    capacity, best = 12, packing.SumOfSquares(12)
    for n in range(300):
        size = rng.randint(1, 11)
        before = best.level.copy()
        options = []
        for h in range(capacity - size + 1):
            if h and not before[h]:
                continue
            after = before.copy()
            after[h] -= h > 0
            if h + size < capacity:
                after[h + size] += 1
            options.append((after[1:capacity] ** 2).sum())
        best.place((n, 0, size), size)
        assert (best.level[1:capacity] ** 2).sum() == min(options)
        assert [len(w) for w in best.windows[1:]] == best.level[1:capacity].tolist()
    assert len(list(best.close())) >= 1


def test_without_dropout_pieces_are_the_librarys(spark, piece_bpe):
    model = SentencePieceProcessor(model_file=piece_bpe)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = pieces.encode(docs, piece_bpe, dropout=0.0).select("text", "ids").collect()
    assert all(list(r.ids) == model.encode(r.text) for r in rows)


def test_dropout_varies_repeatably_and_loses_nothing(spark, piece_bpe):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    runs = []
    for seed in (1, 1, 2):
        both = pieces.decode(pieces.encode(docs, piece_bpe, 0.2, seed), piece_bpe)
        runs.append({r.doc_id: list(r.ids) for r in both.filter(pieces.lossless()).collect()})
        assert len(runs[-1]) == docs.count()
    assert runs[0] == runs[1] != runs[2]
    word = pieces.Vocabulary(piece_bpe)
    cuts = {tuple(np.frombuffer(word.merge([" international"], 0.3, key)[0], "<i4")) for key in range(40)}
    assert len(cuts) > 5 and {b"".join(word.bytes[i] for i in cut) for cut in cuts} == {b" international"}


def test_pieces_of_odd_rows(odd, odd_rows, nothing, piece_bpe):
    for dropout in (0.0, 0.5, 1.0):
        both = pieces.decode(pieces.encode(odd.repartition(3), piece_bpe, dropout), piece_bpe)
        rows = both.select("text", "ids", pieces.lossless().alias("same")).collect()
        assert len(rows) == len(odd_rows) and all(r.same for r in rows)
        assert all((not r.ids) == (not r.text) for r in rows)
    assert pieces.encode(nothing, piece_bpe).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.floats(0, 1), st.integers(0, 7))
def test_any_text_comes_back(text, dropout, key):
    import public_tokenizers

    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), dropout)
    ids = np.frombuffer(v.encode([text], [key], dropout, 3, 4)[0], "<i4")
    assert b"".join(v.bytes[i] for i in ids)[1:].decode() == text


def test_null_ids_decode_to_null(spark, piece_bpe):
    df = spark.createDataFrame([(1, [5]), (2, []), (3, None)], "n int, ids array<int>")
    got = {r.n: r.decoded for r in pieces.decode(df, piece_bpe).collect()}
    assert got[2] == "" and got[3] is None and F is not None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeinorst .,A1é", max_size=40), st.sampled_from([0.0, 0.1, 0.6]), st.integers(0, 99))
def test_short_and_long_parts_have_one_agenda(text, dropout, key):
    import public_tokenizers

    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert v._merge_short([text, "x"], dropout, key)[0] == v._merge_long(text, dropout, key)
    assert "".join(v.split(text)) == text


def test_dropout_varies_with_place_and_row(spark, piece_bpe):
    v = pieces.Vocabulary(piece_bpe)
    apart = [v.encode([" international"], [n], 0.3, 1)[0] for n in range(300)]
    assert len(set(apart)) > 8
    docs = spark.range(300).selectExpr("id AS doc_id", "'international law' AS text")
    assert pieces.encode(docs, piece_bpe, 0.3).select("ids").distinct().count() > 20
    whole = np.frombuffer(v.encode(["international " * 300], [1], 0.3, 1)[0], "<i4").tolist()
    words, own = set(), b""
    for i in whole:
        if v.bytes[i].startswith(b" ") and own:
            words.add(tuple(cut))
        cut, own = ([i], v.bytes[i]) if v.bytes[i].startswith(b" ") else ([*cut, i], own + v.bytes[i])
    assert len(words) > 8


def test_looked_up_merges_are_those_of_the_agenda(piece_bpe, monkeypatch):
    docs = ["Some words, of 1,200 characters: internationalisation éa 日本 " * 20, "x" * 200 + " words words", ""]
    kept = pieces.Vocabulary(piece_bpe)
    for dropout in (0.0, 0.1, 0.6, 1.0):
        got = [kept.encode(docs, [1, 2, 3], dropout, 5) for _ in range(2)]
        fresh = pieces.Vocabulary(piece_bpe)
        monkeypatch.setattr(pieces, "SHORT_PART", 0)  # every part by its own agenda
        assert got[0] == got[1] == fresh.encode(docs, [1, 2, 3], dropout, 5, 0)
        monkeypatch.undo()


def test_slices_and_generations_change_nothing(piece_bpe, monkeypatch):
    texts = ["Words, of 1,200 characters:\n\n  internationalisation éa 日本 \n" * 30, "", "plain words " * 40]
    whole = pieces.Vocabulary(piece_bpe).encode(texts, [1, 2, 3], 0.3, 5)
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 50)
    assert pieces.Vocabulary(piece_bpe).encode(texts, [1, 2, 3], 0.3, 5) == whole
    few = pieces.Vocabulary(piece_bpe)
    assert few.encode(texts, [1, 2, 3], 0.3, 5, kept=3) == whole and len(few.young.parts) + len(few.old.parts) < 40


def test_a_batch_leaves_the_worker_in_small_arrays(spark, piece_bpe, monkeypatch):
    """The ids of a whole batch were held at once before: thousands of rows in one array."""
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 2_000)
    texts = ["Words, of 1,200 characters: internationalisation 日本 " * 4, None, "", "long words " * 900, "a"] * 120
    batch = pa.array(texts), pa.array(range(len(texts)))
    held = []
    for empty in (0, 1):
        given = [tuple(x.slice(0, 0) for x in batch)] * empty + [batch]
        held.append(list(pieces.encoded(piece_bpe, 0.3, 5).func(iter(given))))
    ids = pa.concat_arrays(held[0])
    assert pa.concat_arrays(held[1]).equals(ids) and ids.type == pa.list_(pa.int32())
    assert max(len(x) for x in held[0]) < 40 and max(len(x.values) for x in held[0]) < 9_000 < len(ids.values)


def test_decoding_takes_no_worker_and_equals_the_bytes(spark, piece_bpe, plan_of):
    """Workers that changed roles held the encoder's tables twice over before."""
    v, draw = pieces.Vocabulary(piece_bpe), random.Random(5)
    byte = [v.byte[x] for x in (0xE6, 0x97, 0xA5, 0xFF, 0xC3, 0x41, 0xF0, 0x9F, 0x80)]
    rows = [(n, [draw.choice([draw.randrange(v.size), *byte]) for _ in range(draw.randrange(12))]) for n in range(400)]
    both = pieces.decode(spark.createDataFrame(rows, "n int, ids array<int>"), piece_bpe)
    got = {r.n: r.decoded for r in both.collect()}
    assert got == {n: b"".join(v.bytes[i] for i in ids)[1:].decode("utf-8", "replace") for n, ids in rows}
    docs = spark.range(1)
    assert not re.search("Python|Arrow", plan_of(pieces.decode(docs.selectExpr("array(5) AS ids"), piece_bpe)))
    for wrong in ("array(-1)", f"array(5, {v.size})", "array(5, NULL)"):
        with pytest.raises(Exception, match="no piece"):
            pieces.decode(docs.selectExpr(f"{wrong} AS ids"), piece_bpe).collect()


def test_parts_are_cut_side_by_side_as_one_by_one(piece_bpe):
    v, draw = pieces.Vocabulary(piece_bpe), random.Random(6)
    parts = {"".join(draw.choices("ab1,é日▁ \x00𝒳", k=draw.randrange(1, 9))) for _ in range(3_000)} | {"\n", " ", "plain"}
    expected = {part: "\n".join(cut) for part in parts if len(cut := v.split(part)) > 1}
    assert v._parted(list(parts)) == expected and len(expected) > 500
    assert v._parted([]) == v._parted(["\n"]) == {}


def test_tables_of_parts_hold_little_more_than_the_parts(piece_bpe):
    v, draw = pieces.Vocabulary(piece_bpe), random.Random(4)
    for n in range(40):
        v.encode([" ".join("".join(draw.choices(["er", "in", "al", "st"], k=6)) for _ in range(200)) + " é日本"], [n], 0.1, 1)
    runs, parts = v.young, len(v.young.parts)
    assert parts > 2_000
    assert len(runs.merges) < 1.5 * runs.merge_ends[parts] and len(runs.ids) < 1.5 * runs.id_ends[parts]
    assert v.cut and all(isinstance(cut, str) and cut.replace("\n", "") == part for part, cut in v.cut.items())


def test_numbers_of_many_keys():
    keys = np.random.default_rng(1).integers(-(2**40), 2**40, 5000)
    keys = np.unique(keys)
    table = pieces.Numbers(keys, np.arange(len(keys)), -1)
    assert (table(keys) == np.arange(len(keys))).all() and (table(keys + (1 << 45)) == -1).all()


def test_many_units_are_encoded_as_one_text(byte_bpe):
    units = ["plain", "a  b", " ", "", "x\n", "\ny", "<|endoftext|>", "日本語", "don't", "1,200"]
    encoder = tokens.UnitEncoder(byte_bpe, tokens._blobs)
    got = dict(encoder._together(units))
    expected = library_ids(byte_bpe, [" " + u for u in units])
    assert [got[u] for u in units] == [np.array(x, "<u4").tobytes() for x in expected]


def test_units_are_those_of_safe_spaces_whatever_the_white_space():
    """The quick cut at every space is taken only where it gives the same; no lone search for a text's ends."""
    draw = random.Random(3)
    signs = ["a", "é", "\ud800", " ", " ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "​"]
    for _ in range(20_000):
        piece = "".join(draw.choices(signs, k=draw.randrange(9)))
        assert tokens._units(piece) == tokens.SAFE.split(piece), repr(piece)
    assert tokens.DOUBLE_SPACE.pattern == r"\s\s"
