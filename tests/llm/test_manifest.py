"""The Merkle manifest against a plain one, and places by bitmap ranks."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cartwright.llm import manifest
from cartwright.llm.ranks import ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = ["" if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h(*["-" if x is None else f"{len(v.encode())}:{v}" for x, v in zip((doc_id, source, lang, n_chars, text), values, strict=True)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = at // 3 * 3
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
        at //= 3
    return out


def changed(doc_id, text):
    even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
    return text.replace("\n", "") if even and text is not None else text


def plain(rows):
    """Rows as (doc_id, source, leaf, subroot, root, proof, folded root); ties in the order of their leaves."""
    by_source = {}
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf(doc_id, text, lang, source, n_chars)
        found = leaf(doc_id, changed(doc_id, text), lang, source, n_chars)
        by_source.setdefault(source, []).append((doc_id is not None, doc_id or 0, own, found, doc_id))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in by_source[s]]) for s in names if by_source[s].sort() is None}
    upper = tree([trees[s][-1][0] for s in names])
    out = Counter()
    for at, s in enumerate(names):
        for i, (_, _, own, found, doc_id) in enumerate(by_source[s]):
            steps = path(trees[s], i) + path(upper, at)
            node = found
            for left, right in steps:
                node = h(left, node, right)
            proof = h(*[x for step in steps for x in step])
            out[doc_id, s, own, trees[s][-1][0], upper[-1][0], proof, node, node == upper[-1][0]] += 1
    return out


def audited(df):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = F.coalesce(F.when(even, F.replace("text", F.lit("\n"), F.lit(""))), "text")
    names = ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r[c] for c in names) for r in manifest.audited(df, found).collect())


def test_odd_rows(odd, odd_rows, nothing):
    assert audited(odd) == plain(odd_rows)
    assert manifest.audited(nothing).collect() == []


@pytest.mark.parametrize("n", [1, 3, 4, 81, 82, 700])
def test_one_source_of_a_few_or_many(spark, n):
    rng = random.Random(n)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(n - n // 2)] + rng.sample(range(10 * n), n // 2)
    rows = [(i, f"text\nof {i}", "en", "s", 1) for i in ids]
    found = audited(spark.createDataFrame(rows, SCHEMA))
    assert found == plain(rows)
    assert all(r[-1] == (zlib.crc32(str(r[0]).encode()) % 2 == 1) for r in found)


def test_many_sources_and_a_hot_doc_id(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40), f"t{rng.randrange(3)}", None, rng.choice([None, "", "é", "z", f"s{i}"]), i) for i in range(300)]
    rows += [(7, "same", "en", "z", 0)] * 150 + [(7, f"other {i}", "en", "z", 0) for i in range(50)]
    assert audited(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_only_crowded_words_are_sorted(spark, plan_of):
    rows = [(3 * i, "t", None, f"s{i % 2}", 0) for i in range(500)]
    leaves = manifest._leaves(spark.createDataFrame(rows, SCHEMA), F.col("text"))
    placed = manifest.placed(leaves)
    assert "rangepartitioning" not in plan_of(placed)
    places = {(r["key"], r["doc_id"]): r["place"] for r in placed.collect()}
    assert places == {(f"=s{i % 2}", 3 * i): i // 2 for i in range(500)}


def test_ranks_with_ties_nulls_and_nothing(spark):
    rows = [(x, i) for i, x in enumerate([None, 3, 3, 1, None, 2] * 20)]
    df = spark.createDataFrame(rows, "x int, i int")
    got = {r["i"]: r["rank"] for r in ranked(df, ["x", "i"]).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {i: at for at, (_, i) in enumerate(order)}
    assert ranked(df.filter("false"), ["x"]).collect() == []
