"""Evaluation of scores against labels; every measure is one aggregate, null where undefined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running


def confusion(rows: DataFrame, label: str, flag: str) -> DataFrame:
    """(tp, fp, fn, tn)."""
    y, f = F.col(label), F.col(flag)
    cells = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    return rows.agg(*(F.count_if((y == a) & (f == b)).alias(c) for c, (a, b) in cells.items()))


def measures(cells: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, specificity and f1."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumns({
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn), "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn),
        "specificity": F.try_divide(tn, tn + fp), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
    })


def _by_score(rows: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, s, p, n): positives and negatives of each distinct score, with those below it and all of them."""
    counted = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    return running(counted, "s", ("p", "n"), by=by)


def auc(rows: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the curve by mid-ranks, ties counting half: rows are added up by distinct score, and scores in ranges. One row, or one for each of the few groups ``by``, all in one pass."""
    won = _by_score(rows, label, score, by).withColumn("won", F.col("p") * (F.col("below_n") + F.col("n") / 2)).groupBy(*by).agg(F.sum("won").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return won.select(*by, F.try_divide(F.col("w"), (F.col("p") * F.col("n")).cast("double")).alias("auc"))


def evaluate(rows: DataFrame, label: str, flag: str, score: str) -> DataFrame:
    """One row: cells, measures and auc."""
    return measures(confusion(rows, label, flag)).join(auc(rows, label, score), F.lit(True))


def roc_points(rows: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr) at each distinct score, the rows at or over it counted as positive; null where a class is empty."""
    share = lambda c: F.try_divide(F.col(f"all_{c}") - F.col(f"below_{c}"), F.col(f"all_{c}"))
    return _by_score(rows, label, score).select(F.col("s").alias("threshold"), share("p").alias("tpr"), share("n").alias("fpr"))
