"""Lists of phrases against one replacement after the other."""

from __future__ import annotations

import random

import pytest

from lexigrid.operators import phrases as ph


def one_by_one(text, phrases):
    for p in phrases:
        text = text.replace(p, p.replace(" ", "_"))
    return text


@pytest.mark.parametrize("seed", range(8))
def test_equals_replacing_one_by_one(seed):
    """Few letters, so that phrases overlap, contain each other, repeat and begin or end with spaces."""
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("ab  c") for _ in range(n))
    for _ in range(400):
        phrases = [piece(rng.randint(1, 5)) for _ in range(rng.randint(0, 12))]
        text = piece(rng.randint(0, 40))
        assert ph.PhraseAutomaton(phrases).join(text) == one_by_one(text, phrases), (text, phrases)


def test_many_phrases_over_rows(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(3)) for _ in range(300)]
    phrases = [f"{rng.choice(words)} {rng.choice(words)}" for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(30)] + [None, "", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.joined for r in ph.combine_listed(df.withColumnRenamed("k", "k"), "text", phrases).collect()}
    assert got == {i: None if t is None else one_by_one(t, phrases) for i, t in enumerate(texts)}
    assert ph.combine_listed(df.filter("false"), "text", phrases).count() == 0 and ph.combine_listed(df, "text", []).filter("joined <> text").count() == 0


def test_lists(spark):
    df = spark.createDataFrame([("b a", 2.0), ("a b", 2.0), ("z z", 3.0)], "phrase string, z double")
    assert ph.phrase_list(df, ("z",)) == ["a b", "b a", "z z"]
    with pytest.raises(ValueError, match="more than 2"):
        ph.phrase_list(df, ("z",), most=2)
    with pytest.raises(ValueError, match="underscore"):
        ph.combine_listed(df, "phrase", ["a b_c"])
