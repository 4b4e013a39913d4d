"""The corpus pipeline, stage by stage against plain versions, and over odd documents."""

from collections import Counter

import pytest

import corpus_pipeline as pipeline
from cartwright.llm import near_dedup

import test_texts as plain

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    out.append(docs)
    for name, stage in pipeline.STAGES:
        out.append(pipeline.stored(stage(spark, out[-1], SF_DIR), name.replace(" ", "-")))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns_of_documents(results):
    assert all(df.columns == DOCUMENTS for df in results[:-1])
    assert [name for name, _ in pipeline.STAGES] == [
        "toxicity", "exact dedup", "near dedup", "substring dedup", "packing",
    ]


def test_clean_documents_stay(spark, results):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = {i for i, _ in texts(results[1])}
    gone = {i for i, _ in texts(results[0])} - kept
    clean = [i for i, t in labels.items() if not t]
    assert sum(i in gone for i in clean) <= 0.05 * len(clean)


def test_one_document_of_each_text(results):
    best = {}
    for doc_id, text in texts(results[1]):
        best[text] = max(doc_id, best.get(text, doc_id))
    assert sorted((i, t) for t, i in best.items()) == sorted(texts(results[2]))


def test_one_document_of_each_class(results):
    rows = texts(results[2])
    classes = plain.plain_classes(rows, near_dedup.inverse_frequencies(results[2], 5))
    assert {i for i, _ in texts(results[3])} == set(classes.values())


def test_earlier_passages_are_gone(results):
    expected = plain.plain_repeats(texts(results[3]), 20)
    before = dict(texts(results[3]))
    after = {r.doc_id: r for r in results[4].collect()}
    for doc_id, (_, removed, kept) in expected.items():
        assert after[doc_id].text == (kept if removed else before[doc_id])
        assert after[doc_id].n_chars == len(after[doc_id].text)
    assert len(after) == len(expected)


def test_every_id_is_packed(results, byte_bpe):
    from test_tokens import check_pieces, library_ids

    expected = [x + [1] for x in library_ids(byte_bpe, [t for _, t in texts(results[4])])]
    check_pieces(results[5].collect(), expected, 2048)


def test_odd_documents_pass_all_stages(spark, odd, nothing):
    """Own columns, named like the operators' own or with dots, come out with the values of the rows that stay."""
    odd = odd.selectExpr("*", "concat('dotted ', doc_id) AS `a.b`", "9.0D AS p_insult")
    rest = [c for c in odd.columns if c not in ("text", "n_chars")]
    given = Counter(tuple(r[c] for c in rest) for r in odd.collect())
    for docs, some in ((odd, True), (nothing, False)):
        for _, stage in pipeline.STAGES[:-1]:
            new = stage(spark, docs, SF_DIR)
            assert new.columns == docs.columns
            docs = pipeline.stored(new, "odd")
        if some:
            held = Counter(tuple(r[c] for c in rest) for r in docs.collect())
            assert held and held <= given
        assert (pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() > 0) == some
