"""New items scored against a static bank as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..operators import terms


def weights(items: DataFrame) -> DataFrame:
    """(doc, term, w) of items (id, text): word counts over the norm of their item."""
    dtm = terms.counts(terms.doc_tokens(items, "id", t.clean_text(F.col("text"))))
    norms = dtm.groupBy("doc").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return dtm.join(norms, "doc").select("doc", "term", (F.col("n") / F.col("norm")).alias("w"))


def against_weights(new: DataFrame, bank: DataFrame, least: float = 0.5) -> DataFrame:
    """(new_id, id, cosine) of new items (id, text) and a bank's weights, of at least that cosine."""
    a = weights(new).select(F.col("doc").alias("new_id"), "term", F.col("w").alias("wa"))
    b = bank.select(F.col("doc").alias("id"), "term", F.col("w").alias("wb"))
    out = a.join(b, "term").groupBy("new_id", "id").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return out.filter(F.col("cosine") >= least)


def against_bank(new: DataFrame, bank: DataFrame, least: float = 0.5) -> DataFrame:
    """(new_id, id, cosine) of new items (id, text) and bank items (id, text) with at least that cosine of word counts."""
    return against_weights(new, weights(bank), least)


def score_stream(new: DataFrame, bank: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, least: float = 0.5) -> StreamingQuery:
    """Starts a query that hands each micro-batch's candidate pairs to sink(pairs, batch).

    The bank's weights are computed once, into a table beside the checkpoint that each start writes anew, so that
    a batch reads them and does not clean the bank's texts again.
    """
    path = f"{checkpoint.rstrip('/')}-bank-weights"
    weights(bank).write.mode("overwrite").parquet(path)
    known = bank.sparkSession.read.parquet(path)
    return new.writeStream.foreachBatch(lambda df, n: sink(against_weights(df, known, least), n)).option("checkpointLocation", checkpoint).start()
