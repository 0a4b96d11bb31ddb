"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, language_id, ngram_join, quality_rules, token_counts, toxicity
from .byte_bpe import op11_byte_bpe
from .common import table
from .hard_negatives import op12_hard_negatives
from .media import op10_media
from .mixing import op9_mixing
from .ngram_join import op6_ngram_join
from .packing import op8_packing
from .quality_rules import op4_quality_rules
from .secret_scan import op7_secrets
from .sharding import op1_sharding
from .spelling import op13_spelling


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.toxicity(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = token_counts.token_counts(docs, "word_bpe_49k.json")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit_languages(docs, ~language_id.held_out())
    return language_id.language_id(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_token_counts, op4_quality_rules, op5_language_id, op6_ngram_join, op7_secrets, op8_packing, op9_mixing, op10_media, op11_byte_bpe, op12_hard_negatives, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality_rules.OP4_SQL, "op6_ngram_join": ngram_join.OP6_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL}
