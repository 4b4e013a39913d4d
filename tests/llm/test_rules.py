"""The rule ledger, its policies and ablations, in plain Python."""

import random
import re
from collections import Counter

from cartwright.llm import quality_rules as q


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
        len(lines) - len(set(lines)), len(covered),
    )


def rows_of(df):
    return Counter(tuple(r[c] for c in ("doc_id", *q.MEASUREMENTS)) for r in df.collect())


def test_measurements_of_odd_rows(odd, odd_rows, nothing):
    assert rows_of(q.ledger(odd)) == Counter((i, *measured(t)) for i, t, *_ in odd_rows)
    assert q.ledger(nothing).count() == 0


def test_measurements_of_random_texts(spark):
    rng = random.Random(4)
    rows = [
        (i, "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\x0b", "#", "|", "a b a b a "]) for _ in range(rng.randint(0, 120))))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(q.ledger(df)) == Counter((i, *measured(t)) for i, t in rows)


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))) for i in range(60)]
    rows += [(60, "w " * 3000), (61, " ".join(str(n // 2 % 700) for n in range(3000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window_hash in ("0L", "xxhash64({}) & 3"):
        monkeypatch.setattr(q, "WINDOW_HASH", window_hash)
        assert rows_of(q.ledger(df)) == Counter((i, *measured(t)) for i, t in rows)


def test_ledger_plan_has_neither_shuffle_nor_python(spark, plan_of):
    plan = plan_of(q.ledger(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    assert "Exchange" not in plan and "Python" not in plan


def test_policies_and_ablations(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(1 << len(q.RULES))) for i in range(500)]
    ledger = spark.createDataFrame(rows, "doc_id long, fail_bits long")
    bit = {r.name: 1 << r.bit for r in q.RULES}
    expected = {}
    for policy in q.POLICIES:
        whole = sum(bit[n] for n in policy.rules)
        kept = sum(b & whole == 0 for _, b in rows)
        assert ledger.filter(q.passes(policy.version)).count() == kept
        for name in policy.rules:
            expected[policy.version, name] = (
                sum(b & bit[name] > 0 for _, b in rows), sum(b & whole == bit[name] for _, b in rows), kept,
            )
    found = q.ablations(ledger).collect()
    assert {(r.policy, r.rule): (r.n_fail, r.n_only, r.n_kept) for r in found} == expected


def test_bits_are_their_own():
    assert len({r.bit for r in q.RULES}) == len({r.name for r in q.RULES}) == len(q.RULES)
