"""The classifier chain on held-out and odd documents."""

import random
from collections import Counter

import numpy as np
import pytest

from cartwright.llm import toxicity

SF_DIR = "/root/testdata/sf0.1"
INSULTS = ("idiot", "moron", "loser", "clown", "stupid")


def made(rng, toxic):
    own = [rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice(["ing", "ed", "s", ""]) for _ in range(rng.randint(20, 80))]
    if toxic:
        own[rng.randrange(len(own))] = rng.choice(INSULTS)
        own[rng.randrange(len(own))] = rng.choice(["zorgu", "zorgling", "zorgest"])
    return " ".join(own)


@pytest.fixture(scope="module")
def made_rows(spark):
    rng = random.Random(11)
    rows = [(i, made(rng, i % 6 == 0), int(i % 6 == 0)) for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_documents(made_rows):
    labels = made_rows.filter("doc_id < 600").select("doc_id", "toxic")
    scored = toxicity.toxic_documents(made_rows, labels).filter("doc_id >= 600").collect()
    right = sum(r.rejected == (r.doc_id % 6 == 0) for r in scored)
    assert len(scored) == 300 and right >= 297
    assert all(0 <= r[f"p_{c}"] <= 1 for r in scored for c in toxicity.CATEGORIES)


def test_held_out_documents_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    known, held = labels.filter("doc_id % 5 != 0"), labels.filter("doc_id % 5 = 0")
    scored = toxicity.toxic_documents(docs, known).join(held, "doc_id").collect()
    toxic = [r.rejected for r in scored if r.toxic]
    clean = [r.rejected for r in scored if not r.toxic]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02
    for lang in ("en", "de", "fr", "es"):  # the grades say something in every language
        for grade in toxicity.GRADES:
            bad, good = (np.array([r[f"p_{grade}"] for r in scored if r.lang == lang and r.toxic == t]) for t in (1, 0))
            assert (bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2 > 0.85, (lang, grade)


def test_grades_equal_a_plain_count(spark):
    """Typical features of the other folds, counted in dictionaries."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        toxic = int(rng.random() < 0.3)
        own = set(rng.sample(range(40), rng.randint(0, 8))) | (set(rng.sample(range(100, 104), rng.randint(1, 3))) if toxic and rng.random() < 0.8 else set())
        own |= {200} if rng.random() < (0.5 if toxic else 0.04) else set()
        rows.append((i, rng.randrange(toxicity.FOLDS), toxic, rng.choice("xy"), sorted(own)))
    df = spark.createDataFrame(rows, "row long, fold int, toxic int, lang string, features array<int>")
    hits = {}
    for fold in range(toxicity.FOLDS):
        seen = {t: [set(r[4]) for r in rows if r[1] != fold and r[2] == t] for t in (0, 1)}
        held = {t: Counter(f for own in seen[t] for f in own) for t in (0, 1)}
        typical = {
            f for f, n in held[1].items() if n >= toxicity.TYPICAL_ROWS
            and n / len(seen[1]) >= toxicity.TYPICAL_RATIO * (held[0][f] + 0.5) / len(seen[0])
        }
        hits |= {r[0]: len(typical & set(r[4])) * r[2] for r in rows if r[1] == fold}
    middle = {lang: np.median([hits[r[0]] for r in rows if r[3] == lang and hits[r[0]]]) for lang in "xy"}
    found = {r.row: (r.explicit, r.heavy) for r in toxicity.graded(df).collect()}
    assert found == {i: (int(hits[i] > 0), int(hits[i] >= middle[lang])) for i, _, _, lang, _ in rows}
    assert 0 < sum(h for _, h in found.values()) < sum(e for e, _ in found.values()) < sum(r[2] for r in rows)
    for none in (df.filter("toxic = 0"), df.limit(0), df.filter("row < 9")):
        assert not toxicity.graded(none).filter("explicit + heavy > 0").count()


def test_odd_rows(spark, odd, odd_rows, nothing, made_rows):
    labels = made_rows.filter("doc_id > 30").select("doc_id", "toxic")
    both = odd.select("doc_id", "text").unionByName(made_rows.filter("doc_id > 30").select("doc_id", "text"))
    chain = toxicity.fit_chain(toxicity.labelled(both, labels), toxicity.CATEGORIES)
    out = toxicity.score(odd, chain, toxicity.CATEGORIES).collect()
    assert len(out) == len(odd_rows) and out[0].features == "own features"
    assert {r.rejected for r in out if not r.text} == {False}
    assert {r.rejected for r in out if r.doc_id == 15} == {True}
    assert toxicity.score(nothing, chain, toxicity.CATEGORIES).count() == 0


def test_without_labels_nothing_is_rejected(spark, odd, odd_rows, nothing):
    for labels in ([], [(None, 1), (3, None)]):
        df = spark.createDataFrame(labels, "doc_id long, toxic int")
        out = toxicity.toxic_documents(odd, df).collect()
        assert len(out) == len(odd_rows) and not any(r.rejected or r.p_toxic for r in out)
    assert toxicity.toxic_documents(nothing, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_training_rows_are_bounded(made_rows):
    drawn = toxicity.labelled(made_rows.drop("toxic"), made_rows.select("doc_id", "toxic"), rows=200).count()
    assert 120 < drawn < 280


def test_features_are_words_and_their_beginnings():
    text = "Zorgest, ZORGEST éa".encode()
    doc, feature = toxicity.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(doc) == 6  # two words, each whole and by two prefixes


def test_later_models_see_earlier_logits():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 400).astype(float)
    dense = (truth * 4 - 2 + rng.normal(size=400))[:, None]
    model = toxicity.fit(np.arange(401), np.full(400, 5), dense, truth)
    assert model.dense[0] > 0.5 and not model.weights.any()


def test_threshold_parts_best():
    truth, logit = np.array([0, 0, 1, 0, 1, 1]), np.array([-3.0, -2, -1, 0, 1, 2])
    assert toxicity._best_threshold(truth, logit) == pytest.approx(1 / (1 + np.exp(1.5)))


def test_clean_labels_reject_nothing(made_rows):
    labels = made_rows.filter("toxic = 0").select("doc_id", "toxic")
    assert toxicity.toxic_documents(made_rows.drop("toxic"), labels).filter("rejected").count() == 0
    one = made_rows.filter("toxic = 0 OR doc_id = 6").select("doc_id", "toxic")
    assert toxicity.toxic_documents(made_rows.drop("toxic"), one).filter("rejected").count() < 10
    assert toxicity._best_threshold(np.zeros(4), np.full(4, -8.0)) > 1


def test_rare_toxic_labels_are_drawn(spark, made_rows):
    toxic = made_rows.filter("toxic = 1 AND doc_id < 400").select("doc_id", "toxic")
    clean = made_rows.filter("toxic = 0 AND doc_id < 600").select("doc_id", "toxic")
    unseen = spark.range(10_000, 110_000).selectExpr("id AS doc_id", "0 AS toxic")
    docs = made_rows.drop("toxic").unionByName(
        spark.range(10_000, 110_000).selectExpr("id AS doc_id", "concat('alpha beta w', id % 50) AS text")
    )
    labels = toxic.unionByName(clean).unionByName(unseen)
    drawn = toxicity.labelled(docs, labels, rows=1000).groupBy("toxic").sum("weight").collect()
    rows = {r.toxic: r["sum(weight)"] for r in drawn}
    assert rows[1] == toxic.count() and 0.85 < rows[0] / (100_000 + clean.count()) < 1.15
    scored = toxicity.toxic_documents(docs, labels, rows=1000).filter("doc_id BETWEEN 600 AND 899").collect()
    assert sum(r.rejected == (r.doc_id % 6 == 0) for r in scored) >= 290


def test_documents_that_stay_keep_their_columns(spark, made_rows, plan_of):
    docs = made_rows.selectExpr("doc_id", "text", "true AS rejected", "9.0D AS p_toxic", "'x' AS `a.b`")
    labels = made_rows.select("doc_id", "toxic")
    kept = toxicity.without_toxic_documents(docs, labels)
    assert kept.columns == docs.columns
    scored = toxicity.toxic_documents(docs.select("doc_id", "text"), labels)
    stay = {r.doc_id for r in scored.collect() if not r.rejected}
    found = kept.collect()
    assert 0 < len(found) < docs.count() and {r.doc_id for r in found} == stay
    assert {tuple(r)[2:] for r in found} == {(True, 9.0, "x")}
    plan = plan_of(scored)
    assert plan.count("ArrowEvalPython [") <= 1 and "chances" in plan


def test_a_chain_of_two_equals_plain_logistic_fits(spark):
    """Every fold's models fitted by plain gradient descent on dense inputs, the second on the first's unseen logits."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        a, b = rng.random() < 0.4, rng.random() < 0.5
        words = ["alpha"] * (a and rng.random() < 0.9) + ["beta"] * (b and rng.random() < 0.9) + list(rng.choice(["x", "yy", "zzz"], 3))
        rows.append((i, " ".join(words), int(a), int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, first int, second int")
    chain = toxicity.fit_chain(df, ("first", "second"))
    seen = {r.doc_id: r.fold for r in df.selectExpr("doc_id", f"int(pmod(xxhash64(doc_id, 5), {toxicity.FOLDS})) AS fold").collect()}
    fold = np.array([seen[i] for i, *_ in rows])
    text = "".join(t for _, t, *_ in rows).encode()
    bounds = np.concatenate(([0], np.cumsum([len(t) for _, t, *_ in rows])))
    doc, feature = toxicity.features(np.frombuffer(text, np.uint8), bounds)
    names, column = np.unique(feature, return_inverse=True)
    whole = np.zeros((len(rows), len(names)))
    whole[doc, column] = 1

    def plain(x, dense, truth):
        n, positive = len(truth), truth.sum()
        share, hits, misses = truth.mean(), x.T @ truth, x.T @ (1 - truth)
        ratio = np.log((hits + toxicity.PRIOR * share) / positive * (n - positive) / (misses + toxicity.PRIOR * (1 - share)))
        ratio[(hits + misses < toxicity.LEAST_ROWS) | (np.abs(ratio) < toxicity.LEAST_RATIO)] = 0
        inputs = np.concatenate((x[:, ratio != 0] * ratio[ratio != 0], dense, np.ones((n, 1))), 1)
        balance = np.sqrt((n - positive) / positive)
        weight = np.where(truth > 0, max(balance, 1), max(1 / balance, 1)) / n
        ridge = np.full(inputs.shape[1], toxicity.RIDGE / n)
        ridge[-1] = 0
        w = np.zeros(inputs.shape[1])
        for _ in range(60):  # Newton steps
            chance = 1 / (1 + np.exp(-inputs @ w))
            slope = inputs.T @ ((chance - truth) * weight) + ridge * w
            curve = (inputs * (weight * chance * (1 - chance))[:, None]).T @ inputs + np.diag(ridge + 1e-12)
            w -= np.linalg.solve(curve, slope)
        full = np.zeros(len(names))
        full[ratio != 0] = w[: (ratio != 0).sum()] * ratio[ratio != 0]
        return full, w[(ratio != 0).sum() : -1], w[-1]

    dense = np.zeros((len(rows), 0))
    for n, at in enumerate((2, 3)):
        truth = np.array([r[at] for r in rows], float)
        full, own, constant = plain(whole, dense, truth)
        logits = chain.models[n].logits(np.searchsorted(doc, np.arange(len(rows) + 1)), feature, dense)
        expected = whole @ full + dense @ own + constant
        assert np.abs(logits - expected).max() < 0.15 and np.corrcoef(logits, expected)[0, 1] > 0.999
        unseen = np.zeros(len(rows))
        for f in range(toxicity.FOLDS):
            out = fold == f
            a, b, c = plain(whole[~out], dense[~out], truth[~out])
            unseen[out] = whole[out] @ a + dense[out] @ b + c
        dense = np.concatenate((dense, unseen[:, None]), 1)
