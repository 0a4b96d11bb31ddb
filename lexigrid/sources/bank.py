"""Item banks: schemas, readers, writers, and adapters from the test tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import case_when
from ..functions.text import SEED_WORDS, clean_text, paste

TEXTS = ("Stem", "Distractor_A", "Distractor_B", "Distractor_C", "Distractor_D")
# The item states and type that are analysed.
STATUSES = ("Operational", "Pretest ready", "Pretest")
ITEM_TYPE = "SSMC"

ITEM_BANK = T.StructType(
    [T.StructField(c, T.StringType(), c not in ("Surpass_Id", "Item")) for c in ("Surpass_Id", "Item", "Exam", "Item_Status", "Item_Type", "Key", "Enemies", "Enemies_Name")]
    + [T.StructField("Has_Exhibit", T.BooleanType())]
    + [T.StructField(c, T.StringType()) for c in ("Media_Item_Type", "Domain", "Content_Outline", *TEXTS, "Item_Name")]
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_bank(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """An item bank with the fixed schema, from parquet or CSV with a header."""
    reader = spark.read.schema(ITEM_BANK)
    return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path) if kind == "csv" else reader.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """The hand-off between stages: written as parquet and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare_bank(raw: DataFrame) -> DataFrame:
    """Key answer, status and type filters, whole item and text; items without a key answer are dropped."""
    answer = case_when(F.col("Key"), {k: F.col(f"Distractor_{k}") for k in "ABCD"})
    bank = raw.filter(F.col("Item_Status").isin(*STATUSES) & (F.col("Item_Type") == ITEM_TYPE)).withColumn("key_answer", answer)
    bank = bank.withColumns({"Whole_item": paste(*(F.col(c) for c in TEXTS), sep="/ "), "text": paste(F.col("Stem"), F.col("key_answer"))})
    return bank.select("Surpass_Id", "Item", "Stem", "key_answer", "Whole_item", "text", "Item_Name").filter("key_answer <> ''")


def clean_bank(bank: DataFrame, columns: Sequence[str] = ("Stem", "key_answer", "Whole_item", "text", "Item_Name"), words: Sequence[str] = SEED_WORDS) -> DataFrame:
    return bank.withColumns({c: clean_text(F.col(c), words) for c in columns})


def attributes(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("Surpass_Id").cast("string").alias("Surpass_Id"), "Item_Type", "Content_Outline", F.col("Has_Exhibit").cast("int").alias("Has_Exhibit"))


def enemy_edges(raw: DataFrame) -> DataFrame:
    """(id, enemy): the listed enemies of each item, exactly matched; ids are never altered."""
    ids = F.filter(F.split("Enemies", "[^0-9A-Za-z]+"), lambda x: x != "")
    return raw.filter(F.col("Enemies").isNotNull()).select(F.col("Surpass_Id").alias("id"), F.explode(ids).alias("enemy"))


def block_of(lang: str = "lang", n_chars: str = "n_chars") -> Column:
    """Language and binary order of magnitude of the length."""
    return F.concat_ws(":", F.col(lang), F.length(F.bin(F.col(n_chars))))


def items(documents: DataFrame) -> DataFrame:
    """Documents as an item bank: id, text, block, and lang and source as attributes."""
    return documents.select(F.col("doc_id").alias("id"), "text", block_of().alias("block"), "lang", "source", "n_chars")


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook as a folder: one CSV table with a header for each sheet."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/{name}")


def read_sheet(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/{name}")


def read_lexicon(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """(form, lemma, upos), lower-cased, one row a form, from a table with these columns; the first lemma and tag of a form by code point."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("form", "lemma", "upos")])
    raw = spark.read.schema(schema).option("header", True).csv(path) if kind == "csv" else spark.read.schema(schema).parquet(path)
    first = raw.filter("form is not null and upos is not null").groupBy(F.lower("form").alias("form")).agg(F.min(F.struct(F.coalesce(F.lower("lemma"), F.lower("form")).alias("lemma"), F.upper("upos").alias("upos"))).alias("x"))
    return first.select("form", "x.lemma", "x.upos")
