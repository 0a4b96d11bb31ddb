"""Term statistics in long form: (doc, term, n). Nothing is ever made dense."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.porter import stem_column
from ..functions.text import PHRASE, clean_text, combine_phrases, drop_phrases, extract_phrases, padded_select, paste, punctuated_tokens, remove_duplicate_words, tokens
from ..sources.stage import Stages

#: Most words that are broadcast to a join on words.
BROADCAST_WORDS = 300_000


def stop_words(spark: SparkSession) -> list[str]:
    """Spark's English list, as letters only."""
    return sorted({w.replace("'", "") for w in StopWordsRemover.loadDefaultStopWords("english")})


def word_table(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "term string")


def doc_tokens(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """(doc, pos, term) of cleaned texts. Texts are dealt by document, so that what is grouped by document and word moves no more."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(parts, doc).select(F.col(doc).alias("doc"), F.posexplode(tokens(text)).alias("pos", "term"))


def with_words(rows: DataFrame, words: DataFrame, most: int | None = None, n: int | None = None) -> DataFrame:
    """rows (term, …) joined to words (term, df, …), df how many rows have the term; both are written tables, unless ``n``, the number of rows, is given.

    Words in many rows, ``most`` or BROADCAST_WORDS at most, are broadcast; only the rows of the others are shuffled, so no
    word is a hot key.
    """
    often = max(1, -(-(rows.count() if n is None else n) // (most or BROADCAST_WORDS)))
    common = F.broadcast(words.filter(F.col("df") >= often))
    rare = rows.join(F.broadcast(words.filter(F.col("df") >= often).select("term")), "term", "left_anti").join(words.filter(F.col("df") < often), "term")
    return rows.join(common, "term").unionByName(rare)


def counts(toks: DataFrame) -> DataFrame:
    return toks.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))


def without(toks: DataFrame, words: DataFrame) -> DataFrame:
    """Rows whose term is no stop word; the list is a fixed one of a few hundred words."""
    return toks.join(F.broadcast(words), "term", "left_anti")


def min_length(toks: DataFrame, least: int = 3) -> DataFrame:
    return toks.filter(F.length("term") >= least)


def lost_docs(docs: DataFrame, doc: str, dtm: DataFrame) -> DataFrame:
    """Ids of documents that no term is left of."""
    return docs.select(F.col(doc).alias("doc")).join(dtm.select("doc").distinct(), "doc", "left_anti")


def frequent_terms(dtm: DataFrame, share: float = 0.01) -> DataFrame:
    """(term, freq, share) of terms with more than the share of all occurrences."""
    freq = dtm.groupBy("term").agg(F.sum("n").alias("freq"))
    total = freq.agg(F.sum("freq").alias("total"))
    out = freq.join(F.broadcast(total), F.lit(True)).select("term", "freq", (F.col("freq") / F.col("total")).alias("share"))
    return out.filter(F.col("share") > share)


def ngram_counts(toks: DataFrame) -> DataFrame:
    """Counts of words and of adjacent pairs, joined by an underscore, of (doc, pos, term)."""
    after = F.lead("term").over(Window.partitionBy("doc").orderBy("pos"))
    both = toks.select("doc", F.array_compact(F.array("term", F.concat("term", F.lit("_"), after))).alias("terms"))
    return both.select("doc", F.explode("terms").alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))


def tfidf(dtm: DataFrame) -> DataFrame:
    """(doc, term, n, tf, idf, tf_idf): tf = n / sum of n, idf = ln(N / df) over the documents that have a term."""
    stages = Stages(dtm.sparkSession, "tfidf")
    rows = stages.written(dtm.withColumn("total", F.sum("n").over(Window.partitionBy("doc"))), "counts")
    df = stages.written(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    n_docs = rows.agg(F.count_distinct("doc").alias("docs"))
    out = with_words(rows, df).join(F.broadcast(n_docs), F.lit(True))
    out = out.withColumns({"tf": F.col("n") / F.col("total"), "idf": F.log(F.col("docs") / F.col("df"))})
    return out.select("doc", "term", "n", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tf_idf"))


def keyword_strings(weights: DataFrame) -> DataFrame:
    """(doc, keywords): terms by falling tf-idf, then falling count, then term."""
    by = F.struct((-F.round("tf_idf", 9)).alias("w"), (-F.col("n")).alias("n"), "term")
    return weights.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(by)), lambda x: x["term"]), " ").alias("keywords"))


def annotate(toks: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Adds lemma and upos from a lexicon (form, lemma, upos); a word that it lacks is its own lemma and a noun."""
    if lexicon is None:
        return toks.withColumns({"lemma": F.col("term"), "upos": F.lit("NOUN")})
    out = toks.join(lexicon.withColumnRenamed("form", "term"), "term", "left")
    return out.withColumns({"lemma": F.coalesce("lemma", "term"), "upos": F.coalesce("upos", F.lit("NOUN"))})


def remove_verbs(toks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc, text): lemmas in order without the verbs."""
    kept = annotate(toks, lexicon).filter("upos <> 'VERB'").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "lemma"))).alias("x"))
    return kept.select("doc", F.array_join(F.transform("x", lambda x: x["lemma"]), " ").alias("text"))


def keywords_tfidf(docs: DataFrame, doc: str, text: Column, stops: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(doc, keywords): lemmas of nouns and adjectives without stop words, by tf-idf."""
    words = annotate(doc_tokens(docs, doc, text), lexicon).filter(F.col("upos").isin("NOUN", "ADJ")).select("doc", F.col("lemma").alias("term"))
    return keyword_strings(tfidf(counts(without(words, stops))))


def adjacent_pairs(docs: DataFrame, doc: str, text: Column, stops: Sequence[str] = ()) -> DataFrame:
    """(w1, w2) for neighbours that start with a capital; stop words are dropped first, other tokens leave a gap."""
    toks = punctuated_tokens(text)
    if stops:
        toks = F.filter(toks, lambda t: ~F.lower(t).isin(*stops))
    at = docs.select(F.col(doc).alias("doc"), padded_select(toks, "^[A-Z]").alias("t"))
    pairs = at.select(F.explode(F.arrays_zip(F.col("t").alias("a"), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))).alias("b"))).alias("p"))
    return pairs.select(F.col("p.a").alias("w1"), F.col("p.b").alias("w2")).filter("w1 <> '' and w2 <> ''")


def collocations(pairs: DataFrame, min_count: int = 5) -> DataFrame:
    """(w1, w2, n, lambda, z): log odds of the 2x2 table of each pair, 1/2 added to each cell."""
    both = pairs.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))
    left, right = both.groupBy("w1").agg(F.sum("n").alias("n1")), both.groupBy("w2").agg(F.sum("n").alias("n2"))
    total = both.agg(F.sum("n").alias("total"))
    out = both.filter(F.col("n") >= min_count).join(left, "w1").join(right, "w2").join(F.broadcast(total), F.lit(True))
    a, b, c = F.col("n") + 0.5, F.col("n1") - F.col("n") + 0.5, F.col("n2") - F.col("n") + 0.5
    d = F.col("total") - F.col("n1") - F.col("n2") + F.col("n") + 0.5
    out = out.withColumn("lambda", F.log(a) + F.log(d) - F.log(b) - F.log(c))
    return out.select("w1", "w2", "n", "lambda", (F.col("lambda") / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)).alias("z"))


def phrase_features(docs: DataFrame, text: Column, phrases: Sequence[str]) -> DataFrame:
    """(collocate, phrase): the distinct compounds that occur once the phrases are joined; ids never enter."""
    found = docs.select(F.explode(F.regexp_extract_all(combine_phrases(text, phrases), F.lit(PHRASE), F.lit(0))).alias("collocate")).distinct()
    return found.withColumn("phrase", F.replace("collocate", F.lit("_"), F.lit(" ")))


def two_pass_keywords(docs: DataFrame, doc: str, text: Column, name: Column, phrases: Sequence[str], words: Sequence[str], stops: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(doc, text_clean, collocate, keywords): keywords of the text without its phrases, with phrases and name added, cleaned and weighed again; the name where none is left."""
    base = docs.select(F.col(doc).alias("doc"), name.alias("name"), combine_phrases(text, phrases).alias("joined"))
    base = base.select("doc", "name", drop_phrases(F.col("joined")).alias("text_clean"), extract_phrases(F.col("joined")).alias("collocate"))
    first = keywords_tfidf(base, "doc", F.col("text_clean"), stops, lexicon)
    merged = F.replace(paste(F.col("keywords"), F.col("collocate"), F.col("name")), F.lit("_"), F.lit(" "))
    merged = F.replace(remove_duplicate_words(merged), F.lit("NA"), F.lit(""))
    again = base.join(first, "doc", "left").select("doc", clean_text(merged, words).alias("again"))
    second = keywords_tfidf(again, "doc", F.col("again"), stops, lexicon)
    out = base.join(second, "doc", "left").withColumn("keywords", F.coalesce("keywords", "name"))
    return out.select("doc", "text_clean", "collocate", "keywords").filter("keywords <> ''")


def stemmed_counts(toks: DataFrame) -> DataFrame:
    """Counts by stem; the vocabulary is stemmed once a word."""
    stages = Stages(toks.sparkSession, "stems")
    rows = stages.written(counts(toks), "counts")
    stems = stages.written(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("stem", stem_column("term")), "stems")
    return with_words(rows, stems).groupBy("doc", F.col("stem").alias("term")).agg(F.sum("n").alias("n"))
