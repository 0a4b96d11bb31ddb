"""Tests of the findings of round 3: no step moves the terms of all documents by their words."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import similarity, terms

TEXTS = {1: "a a b c", 2: "a b b d", 3: "a running runs", 4: "", 5: "a", 6: "d a running"}


def dtm_of(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "id long, text string")
    return terms.doc_tokens(docs, "id", F.col("text"))


@pytest.mark.parametrize("most", [1, 2, 300_000])
def test_tfidf_with_few_words_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(terms, "BROADCAST_WORDS", most)
    got = {(r.doc, r.term): (r.n, r.tf, r.idf) for r in terms.tfidf(terms.counts(dtm_of(spark))).collect()}
    words = {k: Counter(v.split()) for k, v in TEXTS.items() if v}
    df = Counter(t for w in words.values() for t in w)
    want = {(k, t): (n, n / sum(w.values()), math.log(len(words) / df[t])) for k, w in words.items() for t, n in w.items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("most", [1, 300_000])
def test_stems_with_few_words_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(terms, "BROADCAST_WORDS", most)
    got = {(r.doc, r.term): r.n for r in terms.stemmed_counts(dtm_of(spark)).collect()}
    assert got[(3, "run")] == 2 and got[(6, "run")] == 1 and got[(1, "a")] == 2 and len(got) == 12


def test_counts_by_document_and_word_move_texts_only(spark):
    """One exchange, that of the texts; before, one of all tokens."""
    plan = terms.counts(dtm_of(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc" not in plan


def test_contained_documents(spark):
    d = terms.counts(dtm_of(spark)).select("doc", "term")
    q = spark.createDataFrame([(7, t) for t in "abcdx"] + [(8, "a")], "item long, term string")
    got = {(r.item, r.doc, r.shared, r.n) for r in similarity.contained(d, q, 0.6).collect()}
    assert got == {(7, 1, 3, 5), (7, 2, 3, 5)} | {(8, k, 1, 1) for k in (1, 2, 3, 5, 6)}
