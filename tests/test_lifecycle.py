from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexigrid.functions import text as t
from lexigrid.operators import evaluate, terms
from lexigrid.plans import lifecycle
from lexigrid.streaming.scorer import against_bank, score_stream


def bank(spark, n=36):
    """Items of random words; every fourth item is a near copy of the one before."""
    rng, rows = random.Random(5), []
    for i in range(n):
        words = [f"wo{rng.randint(0, 40)}x" for _ in range(20)] if i % 4 != 3 else rows[-1][1].split()[:-1] + ["odd"]
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "id long, text string").withColumns({"block": F.lit(0), "exam": F.lit("e")})


def test_from_scores_to_retraining(spark):
    items = bank(spark).cache()
    edges = spark.createDataFrame([(i, i - 1) for i in range(3, 36, 4)], "id long, enemy long")
    dtm = items.select(F.col("id").alias("doc"), F.explode(F.split("text", " ")).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))
    base = items.select("id", "exam", F.split("text", " ").alias("words"), t.word_count(F.col("text")).alias("n_words"))
    for kind in lifecycle.SIMILARITIES:
        scored = lifecycle.scores(items, dtm, kind, k=4)
        assert scored.count() > 100
    scored = lifecycle.scores(items, dtm, "vsm", all_pairs=True)
    assert scored.count() == 36 * 35 // 2
    table = lifecycle.feature_table(scored, edges, base, ("exam",)).cache()
    used = ("cosine_value", "jaccard_value")
    out, coefs = lifecycle.classify(table, used, trees=5, node_size=1)
    assert len(coefs) == 3
    assert evaluate.auc(out, "enemy_yes", "prob_prediction_lr").first()["auc"] > 0.95
    assert evaluate.auc(out, "enemy_yes", "prob_prediction_rf").first()["auc"] > 0.75
    topics = items.select("id", F.lit("a").alias("topic"))
    again = lifecycle.retrain(out, items.select("id", "text"), topics, used, trees=(3,), node_sizes=(1,))
    assert again.count() == table.count() and {"text_a", "topic_b", "same_topic", "enemy_original", "enemy_07_rf"} <= set(again.columns)


def test_keyworded_bank(spark):
    rows = [(f"i{k}", f"heart rate falls w{'abc'[k]} w{'abc'[k]}", f"name {k}") for k in range(3)]
    df = spark.createDataFrame(rows, "Item string, text string, Item_Name string")
    got = {r.Item: r for r in lifecycle.keyworded(df, ["heart rate"], terms.word_table(spark, ["the"]), share=0.5).collect()}
    assert got["i0"].collocate == "heart_rate" and got["i0"].keywords.split()[0] == "wa"


def test_stream_scores_each_batch(spark, tmp_path):
    spark.createDataFrame([(100, "red dog runs")], "id long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    static = spark.createDataFrame([(1, "red dog runs fast"), (2, "blue sky")], "id long, text string")
    got = []
    new = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    q = score_stream(new, static, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    spark.createDataFrame([(101, "blue sky")], "id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert [(r.new_id, r.id) for r in got] == [(100, 1), (101, 2)] and got[0].cosine > 0.8
    want = {(r.new_id, r.id): r.cosine for r in against_bank(spark.read.parquet(str(tmp_path / "in")), static).collect()}
    assert {(r.new_id, r.id) for r in got} == set(want) and all(abs(r.cosine - want[r.new_id, r.id]) < 1e-12 for r in got)
