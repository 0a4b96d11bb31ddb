"""The language query against plain counts and plain expectation-maximisation, word by word."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexigrid.llm import language_id, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def words(text):
    return re.findall(r"[a-z\u0080-\U0010ffff]+", (text or "").lower())


def trigrams(word):
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(max(1, len(w) - 2))]


def plain_model(docs):
    seen = {}
    for d in docs:
        if fold(d.doc_id) != 2 and d.lang is not None:
            seen.setdefault(d.lang, Counter()).update(g for w in words(d.text) for g in trigrams(w))
    langs = sorted(seen)
    top = {k: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:20_000]) for k, c in seen.items()}
    grams = set().union(*top.values())
    whole = {k: sum(top[k].values()) + 0.5 * (len(grams) + 1) for k in langs}
    return langs, lambda g: [math.log((top[k].get(g, 0) + 0.5) / whole[k]) for k in langs]


def plain_em(logs):
    """logs: an array with a row for every single word. (shares, penalised likelihood) of the best set."""

    def fitted(which):
        part = logs[:, which]
        top = part.max(1)
        p, share = np.exp(part - top[:, None]), np.full(len(which), 1 / len(which))
        for _ in range(40 if len(which) > 1 else 0):
            new = np.mean([row * share / (row @ share) for row in p], 0)
            moved, share = np.abs(new - share).max(), new
            if moved < 1e-3:
                break
        return share, np.log(p @ share).sum() + top.sum() - 0.5 * (len(which) - 1) * np.log(len(logs))

    order = np.argsort(-fitted(list(range(logs.shape[1])))[0], kind="stable").tolist()
    best = None
    for k in range(1, len(order) + 1):
        share, fit = fitted(order[:k])
        if best and fit <= best[1]:
            break
        best = dict(zip(order[:k], share, strict=True)), fit
    return best[0]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    langs, logs_of = plain_model(docs)
    known = {}
    for r in queries.op5_language_id(spark, SF).collect():
        text = next(d.text for d in docs if d.doc_id == r.doc_id)
        assert r.held_out == (fold(r.doc_id) == 2)
        if not any(map(str.isalpha, text or "")):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        rows = [known.setdefault(w, sum(np.array(logs_of(g)) for g in trigrams(w))) for w in words(text)]
        want = plain_em(np.array(rows))
        best = max(want, key=want.get)
        assert (r.lang_pred, r.score) == (langs[best], pytest.approx(want[best], abs=1e-6))


def test_counted_words_equal_repeated_words():
    rng = np.random.default_rng(2)
    for _ in range(50):
        logs = rng.normal(size=(rng.integers(1, 40), 4)) * 3
        times = rng.integers(1, 30, len(logs))
        which, share = language_id.languages_of(logs, times.astype(float))
        again, shares = language_id.languages_of(np.repeat(logs, times, 0))
        assert which.tolist() == again.tolist() and share == pytest.approx(shares, abs=1e-9)


def test_a_repeated_row_of_one_huge_text(spark):
    """A text of a million words of two languages, twice, and the same words once."""
    rows = [(i, w, lang) for i, (w, lang) in enumerate([("the of thing ering with shall", "en"), ("der ung schlich keit und nicht", "de")] * 50)]
    model = language_id.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    once = "der keit und nicht the of"
    long = " ".join([once] * 170_000)
    found = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame([(1, long), (2, long), (3, " ".join([once] * 400))], "doc_id long, text string"), model).collect()}
    assert {r.lang_pred for r in found.values()} == {"de"}
    assert found[1].score == found[2].score == pytest.approx(found[3].score, abs=1e-6)
