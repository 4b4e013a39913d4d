"""Line, substring, exact and near deduplication against plain versions on small and odd inputs."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwright.llm import exact_dedup, hashing, line_dedup, near_dedup, substring_dedup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_repeats(rows, length):
    """doc_id -> (words, removed, kept) for rows of distinct doc_ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        own = words(text)
        gone = [False] * len(own)
        for i in range(len(own) - length + 1):
            window = tuple(own[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        kept = " ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out[doc_id] = (len(own), sum(gone), kept)
    return out


@pytest.mark.parametrize(("length", "group_rows"), [(4, 3), (7, 10_000), (20, 2)])
def test_repeats_equal_the_plain_version(spark, length, group_rows):
    rng = random.Random(length)
    passages = [" ".join(rng.choices("abcde", k=rng.randint(5, 60))) for _ in range(12)]
    rows = [
        (i, rng.choice(["\n", " ", "\t "]).join(rng.choice(passages) if rng.random() < 0.5 else f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 12))))
        for i in range(80)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = substring_dedup.remove_repeats(df, length, group_rows).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out} == plain_repeats(rows, length)


def test_repeats_in_odd_rows(odd, odd_rows, nothing):
    out = substring_dedup.remove_repeats(odd).collect()
    assert len(out) == len(odd_rows)
    by_id = defaultdict(list)
    for r in out:
        assert r.n_words == len(words(r.text)) and r.n_removed <= r.n_words
        assert len(words(r.kept_text)) == r.n_words - r.n_removed
        assert r.anchor == "own anchor" and r.marks == "own marks"
        by_id[r.doc_id].append(r)
    assert by_id[5][0].kept_text == "" and by_id[6][0].kept_text == "tail"
    assert by_id[9][0].kept_text == "end"
    echo = by_id[14][0]
    assert (echo.n_words, echo.n_removed) == (200, 199)
    assert {r.n_removed for r in by_id[4] if r.n_words == 60} == {0}
    assert substring_dedup.remove_repeats(nothing).count() == 0


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_that_share_polynomial_roots_differ(spark, size):
    """Thue-Morse words over two letters collide under every polynomial hash with an odd base modulo 2**64."""
    head = " ".join(f"w{i}" for i in range(19))
    a, b = thue_morse(size, "ab"), thue_morse(size, "ba")
    data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    starts, ends, _ = hashing.word_spans(data, np.array([0, len(data)]))
    assert len(set(hashing.hash_words(data, starts, ends).tolist())) == 2
    df = spark.createDataFrame([(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{head} {b}")], "doc_id long, text string")
    out = substring_dedup.remove_repeats(df).collect()
    assert {r.doc_id: r.n_removed for r in out} == {1: 0, 2: 0, 3: 20}


def test_own_columns_survive_the_removal(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(1, passage, 7, "own", 0.5), (2, passage + " tail", 7, "own", 0.5), (3, None, None, None, None), (4, "a b", 99, "x", 1.5)]
    df = spark.createDataFrame(rows, "doc_id long, Text string, n_chars long, `n_removed` string, `a.b` double")
    out = substring_dedup.without_repeats(df)
    assert out.columns == df.columns
    found = {r[0]: tuple(r) for r in out.collect()}
    assert found == {1: rows[0], 2: (2, "tail", 4, "own", 0.5), 3: rows[2], 4: rows[3]}


def test_words_and_hashes_of_slices():
    text = ("é" * 50 + " ") * 9000 + "z" * (3 * hashing.SLICE) + "\x0b q"
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, first = hashing.word_spans(data, np.array([0, len(data)]))
    own = [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)]
    assert own == text.encode().split() and first.tolist() == [0, len(own)]
    hashes = hashing.hash_words(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(own))
    big = np.frombuffer(b"z" * (3 * hashing.SLICE), np.uint8)
    assert hashing.hash_words(big, np.array([0]), np.array([len(big)]))[0] == hashes[-2]


def plain_lines(rows, least=10):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    holder = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holder[key(line)] = min(doc_id, holder.get(key(line), doc_id))
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or holder[key(x)] == doc_id]
        out[doc_id] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize(("batches", "fan_in"), [(1, 2), (5, 2), (7, 3)])
def test_lines_equal_the_plain_version(spark, batches, fan_in):
    rng = random.Random(batches)
    pool = ["Common Line %d" % i for i in range(9)] + ["short", "", "É accentué ici", "é accentué ici", "  padded line  \r"]
    rows = [(i * 3, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = line_dedup.drop_repeated_lines(df, 10, batches, fan_in).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in out} == plain_lines(rows)


def test_runs_are_compacted_by_level(spark):
    runs = line_dedup.Runs(spark, 2, 2)
    for batch in range(5):
        keys = spark.range(batch * 10, batch * 10 + 15).select(F.col("id").alias("h1"), F.col("id").alias("h2"), "id")
        runs.add(runs.unseen(keys))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    total = [spark.table(n) for level in runs.levels for n in level]
    assert sorted(r.h1 for t in total for r in t.collect()) == list(range(55))


def test_lines_in_odd_rows(odd, odd_rows, nothing):
    out = line_dedup.drop_repeated_lines(odd).collect()
    assert len(out) == len(odd_rows)
    by_id = defaultdict(list)
    for r in out:
        by_id[r.doc_id].append(r)
        assert r.h1 == "own h1" and r.batch == "own batch"
    assert by_id[12][0].kept_text == "d" and by_id[5][0].kept_text == ""
    assert (by_id[0][0].n_lines, by_id[0][0].kept_text) == (1, "")
    assert {r.n_dropped for r in by_id[4]} == {0}
    assert line_dedup.drop_repeated_lines(nothing).count() == 0


def test_exact_groups_in_odd_rows(odd, odd_rows, nothing):
    groups = defaultdict(list)
    for doc_id, text, *_ in odd_rows:
        groups[text or ""].append(doc_id)
    expected = Counter()
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            keeps = i == best and not kept
            kept |= keeps
            expected[i, best, len(ids), keeps, sha256(text.encode()).hexdigest()] += 1
    for salts in (1, 3):
        found = exact_dedup.duplicate_ledger(odd.repartition(6), salts).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == expected
    assert exact_dedup.duplicate_ledger(nothing).count() == 0


def test_texts_of_one_digest_stay_apart(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_digest", lambda text: F.lit("same"))
    found = exact_dedup.duplicate_ledger(odd.repartition(4), 2).collect()
    sizes = Counter(t or "" for _, t, *_ in odd_rows)
    assert sorted(r.group_size for r in found) == sorted(n for n in sizes.values() for _ in range(n))


def test_one_whole_row_stays(odd, odd_rows, nothing):
    out = exact_dedup.without_duplicates(odd).collect()
    assert sorted(r.text or "" for r in out) == sorted({t or "" for _, t, *_ in odd_rows})
    assert out[0].asDict().keys() == odd.limit(1).collect()[0].asDict().keys()
    assert {r.doc_id for r in out if r.text and r.text.startswith("x")} == {10}
    assert exact_dedup.without_duplicates(nothing).count() == 0


def plain_classes(rows, idf, threshold=0.8, size=5):
    vectors = []
    for _, text in rows:
        own = (text or "").encode()
        s = near_dedup.Shingles(np.frombuffer(own, np.uint8), np.array([0, len(own)]), size)
        vectors.append(dict(zip(s.hash.tolist(), (s.count * idf[s.bucket]).tolist(), strict=True)))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            keys = a.keys() | b.keys()
            top = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
            if not keys or sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) >= threshold * top:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[root(i)].append(row[0])
    return {row[0]: min(groups[root(i)]) for i, row in enumerate(rows)}


def test_classes_equal_the_plain_version(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 30, 80, 200]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 9999)}"
            rows.append((len(rows), rng.choice([" ", "\n"]).join(copy)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    idf = near_dedup.inverse_frequencies(df, 5)
    found = {r.doc_id: r for r in near_dedup.near_duplicates(df).collect()}
    assert {i: r.class_id for i, r in found.items()} == plain_classes(rows, idf)
    assert all(r.kept == (r.class_id == i) for i, r in found.items())


def test_a_large_group_emits_a_pair_per_bucket_and_member(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        copy = list(base)
        copy[rng.randrange(150)] = f"e{i}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_duplicates(df).collect()
    assert {r.class_id for r in found} == {0} and sum(r.kept for r in found) == 1


def test_samples_agree_as_often_as_texts_are_similar():
    rng = random.Random(1)
    a = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(400))
    b = " ".join(a.split()[:300]) + " " + " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(100))
    data = np.frombuffer((a + b).encode(), np.uint8)
    s = near_dedup.Shingles(data, np.array([0, len(a), len(a + b)]), 5)
    idf = 1 + np.linspace(0, 0.5, 1 << near_dedup.FREQUENCY_BITS)
    drawn = near_dedup.samples(s, np.log(idf).astype(np.float32), 2000)
    one = near_dedup.Shingles(data[: len(a)], np.array([0, len(a)]), 5)
    two = near_dedup.Shingles(data[len(a) :], np.array([0, len(b)]), 5)
    similarity = near_dedup.weighted_jaccard(one, two, idf)[0]
    assert abs((drawn[0] == drawn[1]).mean() - similarity) < 0.04


def test_components_of_a_long_path(spark):
    names = [bytes([i]) for i in range(60)]
    links = spark.createDataFrame(list(zip(names, names[1:])) + [(b"\xf0", b"\xf1")], "a binary, b binary")
    labels = {bytes(r.node): bytes(r.label) for r in near_dedup.components(links).collect()}
    assert {labels[n] for n in names} == {b"\x00"} and labels[b"\xf1"] == b"\xf0"


def test_classes_of_odd_rows(odd, odd_rows, nothing):
    found = near_dedup.near_duplicates(odd).collect()
    assert len(found) == len(odd_rows)
    own = {r.doc_id: r.class_id for r in found if r.doc_id not in (None, 4)}
    assert own[0] == own[1] == own[2] and own[8] == own[9] and own[5] == own[6] == own[7] == 4
    kept = near_dedup.without_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {4, 8, 10}
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert near_dedup.without_near_duplicates(nothing).count() == 0
