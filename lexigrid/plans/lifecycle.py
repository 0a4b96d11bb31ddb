"""The whole analysis as functions from DataFrames to DataFrames: keywords, scores, features, models, review, retraining.

Each stage is handed on as parquet (sources.bank.write_stage); nothing is global.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import features, models, report, similarity, terms, topics

SIMILARITIES = ("vsm", "lsa", "lda")


def keyworded(bank: DataFrame, phrases: Sequence[str], stops: DataFrame, share: float = 0.01, lexicon: DataFrame | None = None) -> DataFrame:
    """A cleaned bank with text_clean, collocate and keywords; words over ``share`` of all occurrences are removed from the texts first."""
    counted = terms.counts(terms.without(terms.doc_tokens(bank, "Item", F.col("text")), stops))
    extra = [r.term for r in terms.frequent_terms(counted, share).select("term").collect()]  # fewer than 1 / share words
    words = (*t.SEED_WORDS, *sorted(extra))
    again = bank.withColumn("text", t.clean_text(F.col("text"), words))
    found = terms.two_pass_keywords(again, "Item", F.col("text"), F.col("Item_Name"), phrases, words, stops, lexicon)
    return again.join(found.withColumnRenamed("doc", "Item"), "Item")


def scores(items: DataFrame, dtm: DataFrame, kind: str = "vsm", k: int = 40, all_pairs: bool = False) -> DataFrame:
    """(id_a, id_b, cosine_value or jsd_value) of the pairs of a block, from items (id, block) and (doc, term, n)."""
    if kind == "vsm":
        out = similarity.vsm_cosine(dtm, items.select(F.col("id").alias("doc"), "block")).withColumnRenamed("cosine", "cosine_value")
        return similarity.with_all_pairs(out, similarity.pairs(items), "cosine_value") if all_pairs else out
    if kind == "lsa":
        latent = similarity.lsa(terms.tfidf(dtm), k).join(items.select("id", "block"), "id")
        return similarity.dense_cosine(latent, "block").withColumnRenamed("cosine", "cosine_value")
    rows = dtm.select("doc", F.explode(F.array_repeat("term", F.col("n").cast("int"))).alias("term"))
    v, _ = topics.vectors(rows)
    gamma = topics.doc_topics(topics.fit_lda(v, k), v)
    out = similarity.jsd(gamma.select("id", F.col("topic").alias("key"), F.col("gamma").alias("p")), items.select("id", "block"))
    return out.select("id_a", "id_b", F.col("distance").alias("jsd_value"))


def feature_table(scored: DataFrame, edges: DataFrame, items: DataFrame, same: Sequence[str]) -> DataFrame:
    """Labelled, complete features with is_train."""
    table = features.complete(features.pair_features(features.label_pairs(scored, edges), items, same))
    return table.withColumn("is_train", models.in_train())


def classify(table: DataFrame, used: Sequence[str], trees: int = 100, node_size: int = 10) -> tuple[DataFrame, list[tuple[str, float, float, float]]]:
    """All pairs with both probabilities and the flags; the coefficients of the regression. Fitted to the balanced training split."""
    balanced = models.smote(table.filter("is_train"), used)
    logit = models.fit_logit(balanced, used)
    forest = models.fit_forest(balanced, used, trees=trees, node_size=node_size)
    out = models.score(forest, models.score(logit, table, "prob_prediction_lr"), "prob_prediction_rf")
    return report.flags(out, {"prob_prediction_lr": "lr", "prob_prediction_rf": "rf"}), models.coefficients(logit, used)


def retrain(scored: DataFrame, content: DataFrame, doc_topics: DataFrame, used: Sequence[str], trees: Sequence[int] = (50, 100, 200), node_sizes: Sequence[int] = (5, 10, 15, 20)) -> DataFrame:
    """The review loop: flagged pairs become enemies, same_topic joins the features, the best forest on a validation split is fitted and scores all."""
    rows = report.final_merge(report.relabel(scored), content, doc_topics).drop(*(c for c in scored.columns if c.startswith(("prob_", "enemy_0"))))
    used = [*used, "same_topic"]
    valid = F.col("is_train") & ((F.col("id_a") + F.col("id_b")) % 5 == 0)
    balanced = models.smote(rows.filter("is_train").filter(~valid), used)
    best = models.grid_search(balanced, rows.filter(valid), used, node_sizes=node_sizes, trees=trees)[0]
    forest = models.fit_forest(balanced, used, trees=best["trees"], node_size=best["node_size"])
    return report.flags(models.score(forest, rows, "prob_prediction_rf"), {"prob_prediction_rf": "rf"})
