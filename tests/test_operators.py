from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import evaluate, features, models, report, similarity, terms, topics
from lexigrid.sources import bank


def test_jsd_identical_and_disjoint(spark):
    p = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.5), (2, "b", 0.5), (3, "a", 1.0)], "id long, key string, p double")
    got = {(r.id_a, r.id_b): (r.jsd, r.distance) for r in similarity.jsd(p).collect()}
    assert got[1, 2] == pytest.approx((0, 0), abs=1e-7)
    assert 0 < got[1, 3][0] < math.log(2)


def test_cosine_bounds_and_all_pairs(spark):
    dtm = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 4), (2, "b", 2), (3, "c", 1)], "doc long, term string, n long")
    ids = spark.createDataFrame([(i, 0) for i in (1, 2, 3)], "id long, block int")
    scores = similarity.vsm_cosine(dtm, ids.withColumnRenamed("id", "doc"))
    got = {(r.id_a, r.id_b): r.cosine for r in similarity.with_all_pairs(scores, similarity.pairs(ids), "cosine").collect()}
    assert got == pytest.approx({(1, 2): 1.0, (1, 3): 0.0, (2, 3): 0.0})


def test_auc_ties_and_monotone(spark):
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "y int, s double")
    assert evaluate.auc(tied, "y", "s").first()["auc"] == 0.5
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, s double")
    want = np.mean([(a > b) + (a == b) / 2 for y, a in rows if y for z, b in rows if not z])
    assert evaluate.auc(df, "y", "s").first()["auc"] == pytest.approx(want)
    assert evaluate.auc(df.withColumn("s", F.exp("s")), "y", "s").first()["auc"] == pytest.approx(want)


def test_empty_evaluation_is_null(spark):
    got = evaluate.evaluate(spark.createDataFrame([], "y int, f int, s double"), "y", "f", "s").first()
    assert got.tp == 0 and got.precision is None and got.auc is None


def test_smote_stays_between_neighbours(spark):
    rng = random.Random(2)
    rows = [(i, i + 1, rng.random(), rng.random(), 0) for i in range(60)] + [(i, i + 1, 5 + rng.random(), rng.random(), 1) for i in range(100, 110)]
    df = spark.createDataFrame(rows, "id_a long, id_b long, x double, y double, enemy_yes int")
    out = models.smote(df, ("x", "y")).collect()
    minority = [r for r in out if r.enemy_yes]
    assert len(minority) == 60 and all(5 <= r.x <= 6 and 0 <= r.y <= 1 for r in minority)


def test_logit_recovers_coefficients_and_forest_separates(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 2))
    y = rng.random(4000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] + 0.5)))
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, enemy_yes int").cache()
    coef = {t: (c, p) for t, c, _, p in models.coefficients(models.fit_logit(df, ("a", "b")), ("a", "b"))}
    assert coef["a"][0] == pytest.approx(1.5, abs=0.2) and coef["b"][0] == pytest.approx(-1, abs=0.2) and coef["a"][1] < 1e-6
    scored = models.score(models.fit_forest(df, ("a", "b"), trees=10), df, "p1")
    assert evaluate.auc(scored, "enemy_yes", "p1").first()["auc"] > 0.8
    best = models.grid_search(df, df, ("a", "b"), node_sizes=(5,), trees=(5,))
    assert best[0]["auc"] > 0.8


def test_lsa_keeps_directions(spark):
    rows = [(d, t, w) for d, ts in enumerate([{"a": 1.0, "b": 1.0}, {"a": 1.0, "b": 0.9}, {"c": 1.0, "d": 1.0}, {"c": 0.8, "d": 1.0}]) for t, w in ts.items()]
    vec = similarity.lsa(spark.createDataFrame(rows, "doc long, term string, tf_idf double"), 2, 0, scale=False)
    got = {(r.id_a, r.id_b): r.cosine for r in similarity.dense_cosine(vec).collect()}
    assert got[0, 1] > 0.99 and got[2, 3] > 0.99 and abs(got[0, 2]) < 0.01


def test_lda_finds_planted_topics_and_search(spark):
    rng = random.Random(4)
    words = [["red", "blue", "green"], ["dog", "cat", "cow"]]
    toks = spark.createDataFrame([(d, rng.choice(words[d % 2])) for d in range(60) for _ in range(20)], "doc long, term string")
    v, vocabulary = topics.vectors(toks)
    model = topics.fit_lda(v, 2, 30)
    top = {}
    for r in topics.topic_terms(model, vocabulary, 3).collect():
        top.setdefault(r.topic, set()).add(r.term)
    assert sorted(map(sorted, top.values())) == sorted(map(sorted, words))
    stats = topics.search_topics(v, [2, 3], folds=2, iterations=3)
    assert len(stats) == 4 and all(s["perplexity"] > 0 for s in stats)
    table = spark.createDataFrame([(s["topics"], s["perplexity"], s["likelihood"], s["cao_juan"], s["arun"]) for s in stats], "topics int, perplexity double, griffiths double, cao_juan double, arun double")
    assert topics.consensus(table).count() == 2
    gamma = topics.doc_topics(model, v)
    assert topics.top_topics(gamma, 2).count() == 60


def test_minhash_pairs_find_near_sets(spark):
    sets = spark.createDataFrame([(1, list("abcdefgh")), (2, list("abcdefgx")), (3, list("qrst"))], "id long, words array<string>")
    assert {(r.id_a, r.id_b) for r in similarity.minhash_pairs(sets, 0.6, 32).collect()} == {(1, 2)}


def test_labels_exact_and_by_substring(spark):
    pairs = spark.createDataFrame([(12, 345), (12, 112), (13, 12)], "id_a long, id_b long").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    edges = spark.createDataFrame([(345, 12)], "id long, enemy long")
    assert {r.id_b for r in features.label_pairs(pairs, edges).filter("enemy_yes = 1").collect()} == {345}
    lists = spark.createDataFrame([(12, "1122, 345")], "id long, enemies string")
    assert {r.id_b for r in features.label_by_substring(pairs, lists).filter("enemy_yes = 1").collect()} == {345, 112}


def test_bank_life_cycle(spark, tmp_path):
    empty = dict.fromkeys(bank.ITEM_BANK.names)
    item = empty | {"Surpass_Id": "1", "Item": "i1", "Item_Status": "Operational", "Item_Type": "SSMC", "Key": "B", "Enemies": "2, 3", "Has_Exhibit": True, "Stem": "What, \"is\" 7?", "Distractor_A": "no", "Distractor_B": "Best heart", "Item_Name": "n"}
    rows = [item, item | {"Surpass_Id": "2", "Item": "i2", "Item_Status": "Retired"}, item | {"Surpass_Id": "3", "Item": "i3", "Key": "E"}, item | {"Surpass_Id": "4", "Item": "i4", "Item_Type": "X"}]
    raw = spark.createDataFrame([tuple(r[c] for c in bank.ITEM_BANK.names) for r in rows], bank.ITEM_BANK)
    bank.write_csv(raw, str(tmp_path / "bank"))
    raw = bank.read_bank(spark, str(tmp_path / "bank"), "csv")
    kept = bank.clean_bank(bank.prepare_bank(raw)).collect()
    assert [(r.Surpass_Id, r.key_answer.strip()) for r in kept] == [("1", "heart")]
    assert kept[0].Whole_item.count("na") == 2
    assert {(r.id, r.enemy) for r in bank.enemy_edges(raw).collect()} >= {("1", "2"), ("1", "3")}
    assert bank.attributes(raw).first().Has_Exhibit == 1


def test_stems_and_stop_words(spark):
    toks = spark.createDataFrame([(1, 0, "running"), (1, 1, "runs"), (1, 2, "the")], "doc long, pos int, term string")
    kept = terms.without(toks, terms.word_table(spark, terms.stop_words(spark)))
    assert {(r.term, r.n) for r in terms.stemmed_counts(kept).collect()} == {("run", 2)}


def test_threshold_flags_and_relabel(spark):
    rows = spark.createDataFrame([(1, 0.95, 0), (2, 0.75, 0), (3, 0.1, 1)], "id long, p double, enemy_yes int")
    out = report.flags(rows, {"p": "rf"})
    assert [(r.enemy_07_rf, r.enemy_08_rf, r.enemy_09_rf) for r in out.orderBy("id").collect()] == [(1, 1, 1), (1, 0, 0), (0, 0, 0)]
    assert [r.enemy_yes for r in report.relabel(out).orderBy("id").collect()] == [1, 1, 1]
    assert [(r.n, r.perc) for r in report.threshold_summary(rows, "p").orderBy("threshold").collect()] == [(2, 2 / 3), (1, 1 / 3), (1, 1 / 3)]
