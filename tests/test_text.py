from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import scalar
from lexigrid.functions import text as t
from lexigrid.functions.porter import stem


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "n"), [("a  b", 3), ("a b ", 2), ("", 0), ("a/b_c", 3)])
def test_word_count(spark, text, n):
    assert one(spark, t.word_count(F.lit(text))) == n


def test_clean_text(spark):
    assert one(spark, t.clean_text(F.lit("Él 3-x"))) == "l  x"
    assert one(spark, t.clean_text(F.lit("\tThe best IMAGE of 12 €s\n"))) == "the   of     s"
    assert one(spark, t.clean_text(F.lit(None).cast("string"))) is None


def test_phrases(spark):
    joined = t.combine_phrases(F.lit("heart rate low heart rate"), ["heart rate"])
    assert one(spark, joined) == "heart_rate low heart_rate"
    assert one(spark, t.extract_phrases(joined)) == "heart_rate/heart_rate"
    assert one(spark, t.drop_phrases(joined)) == " low "
    assert one(spark, t.combine_keywords(F.lit("heart rate/ low /x"), ["heart rate"])) == "heart_rate/low/x"


def test_sets(spark):
    assert one(spark, t.remove_duplicate_words(F.lit("b a b"))) == "b a"
    assert one(spark, t.jaccard_value(F.lit("a b"), F.lit("b c"))) == pytest.approx(1 / 3)
    assert one(spark, t.jaccard_value(F.lit(""), F.lit(""))) is None


def test_na_paste_and_theme(spark):
    assert one(spark, t.paste(F.lit("a"), F.lit(None))) == "a NA"
    assert one(spark, t.theme_of(F.lit(None).cast("string"))) == "NA"


def test_scalars(spark):
    assert one(spark, scalar.row_mean([F.lit(1.0), F.lit(None), F.lit(4.0)])) == 2.5
    assert one(spark, scalar.same_flag(F.lit(1), F.lit(None).cast("int"))) is None
    assert one(spark, scalar.finite(F.lit(float("-inf")))) == 0.0
    assert one(spark, scalar.clamp_negative(F.lit(-1.0))) == 0.0


@pytest.mark.parametrize(
    ("word", "stemmed"),
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("generalization", "gener"), ("adjustable", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"), ("by", "by")],
)
def test_porter(word, stemmed):
    assert stem(word) == stemmed


def test_punctuated_tokens_of_any_letters(spark):
    row = spark.range(1).select(t.punctuated_tokens(F.lit("Größe, l'été_2: 日本!")).alias("x")).first()
    assert row.x == ["Größe", ",", "l", "'", "été_2", ":", "日本", "!"]
