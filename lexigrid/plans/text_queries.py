"""Text, term and keyword queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import phrases, terms
from ..sources.bank import read_table
from .fragments import clean, tokens, values
from .registry import query

#: Phrases that the compound queries join, in this order.
PHRASES = ("of the", "the and", "and the", "in the", "de la")


def stop_list() -> list[str]:
    """Short common words of the four languages of the test tables; the production list is terms.stop_words()."""
    return "the and of to in is for on with as at by an be it that this are was or from de la le les et des un une que qui pour par der die das und en el los las y con del".split()


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def stops(spark: SparkSession) -> DataFrame:
    return terms.word_table(spark, stop_list())


def kept_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, pos, term) of cleaned documents without stop words."""
    return terms.without(terms.doc_tokens(docs(spark, sf_dir), "doc_id", t.clean_text(F.col("text"))), stops(spark))


def kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, term, n) of cleaned documents without stop words."""
    return terms.counts(kept_tokens(spark, sf_dir))


KEPT = f"kept AS (SELECT doc, term, count(*) AS n FROM ({tokens()}) WHERE term NOT IN (SELECT * FROM {values(stop_list())}) GROUP BY doc, term)"
TFIDF = f"""{KEPT}, weights AS (
  SELECT doc, term, n, n / sum(n) OVER (PARTITION BY doc) AS tf, ln((SELECT count(DISTINCT doc) FROM kept) / count(*) OVER (PARTITION BY term)) AS idf FROM kept)"""


@query(f"SELECT doc_id, {clean('text')} AS text_clean FROM documents")
def clean_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.clean_text(F.col("text")).alias("text_clean"))


@query(f"SELECT page_id, {clean('html')} AS html_clean FROM pages")
def clean_text_blob(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", t.clean_text(F.col("html")).alias("html_clean"))


@query(r"SELECT doc_id, (length(regexp_replace(text, '[^/_\s]', '', 'g')) + (text <> '' AND NOT regexp_matches(text, '[/_\s]$'))::INT)::BIGINT AS item_length FROM documents")
def item_length(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.word_count(F.col("text")).alias("item_length"))


@query(r"""SELECT conv_id, turn, (SELECT string_agg(w, ' ' ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest(parts) AS w, generate_subscripts(parts, 1) AS p) GROUP BY w) WHERE NOT (w = '' AND p = len(parts))) AS deduped
FROM (SELECT conv_id, turn, string_split_regex(text, '\s+') AS parts FROM conversations)""")
def dedupe_words(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", t.remove_duplicate_words(F.col("text")).alias("deduped"))


def _joined(c: str) -> str:
    for p in PHRASES:
        c = f"replace({c}, '{p}', '{p.replace(' ', '_')}')"
    return c


@query(f"SELECT doc_id, {_joined(clean('text'))} AS joined FROM documents")
def phrase_compound(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.combine_phrases(t.clean_text(F.col("text")), PHRASES).alias("joined"))


@query(rf"SELECT doc_id, array_to_string(regexp_extract_all(j, '\b\w+_\w+\b'), '/') AS collocate, regexp_replace(j, '\b\w+_\w+\b', '', 'g') AS text_clean FROM (SELECT doc_id, {_joined(clean('text'))} AS j FROM documents)")
def phrase_extract(spark, sf_dir):
    joined = docs(spark, sf_dir).select("doc_id", t.combine_phrases(t.clean_text(F.col("text")), PHRASES).alias("j"))
    return joined.select("doc_id", t.extract_phrases(F.col("j")).alias("collocate"), t.drop_phrases(F.col("j")).alias("text_clean"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(s, '/'), lambda w: CASE WHEN trim(w) IN ('small ring', 'Brand two') THEN replace(trim(w), ' ', '_') ELSE trim(w) END), '/') AS keywords
FROM (SELECT p_partkey, p_name || '/ ' || p_type || ' /Brand two' AS s FROM part)""")
def combine_keywords(spark, sf_dir):
    s = F.concat(F.col("p_name"), F.lit("/ "), F.col("p_type"), F.lit(" /Brand two"))
    return read_table(spark, sf_dir, "part").select("p_partkey", t.combine_keywords(s, ("small ring", "Brand two")).alias("keywords"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[[:punct:]]', '', 'g'), '[0-9]+', '', 'g'), '\s+', ' ', 'g') AS plain, regexp_replace(text, '\t', ' ') AS first_tab FROM documents""")
def strip_classes(spark, sf_dir):
    plain = t.strip_whitespace(t.remove_numbers(t.remove_punctuation(F.col("text"))))
    return docs(spark, sf_dir).select("doc_id", plain.alias("plain"), t.replace_first(F.col("text"), "\t", " ").alias("first_tab"))


@query("SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) AS titled, lower(c_mktsegment) AS lowered FROM customer")
def title_case(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", t.title_case(F.col("c_mktsegment")).alias("titled"), F.lower("c_mktsegment").alias("lowered"))


@query(f"SELECT doc, term, count(*) AS n FROM ({tokens()}) GROUP BY doc, term")
def term_counts(spark, sf_dir):
    return terms.counts(terms.doc_tokens(docs(spark, sf_dir), "doc_id", t.clean_text(F.col("text"))))


@query(f"SELECT doc, term, count(*) AS n FROM ({tokens()}) WHERE length(term) >= 3 GROUP BY doc, term")
def dtm_min_length(spark, sf_dir):
    return terms.counts(terms.min_length(terms.doc_tokens(docs(spark, sf_dir), "doc_id", t.clean_text(F.col("text")))))


@query(f"WITH {KEPT} SELECT doc, term, n FROM kept")
def stopword_antijoin(spark, sf_dir):
    return kept_counts(spark, sf_dir)


@query(f"WITH {KEPT}, f AS (SELECT term, sum(n)::BIGINT AS freq FROM kept GROUP BY term) SELECT term, freq, round(freq / (SELECT sum(freq) FROM f), 6) AS share FROM f WHERE freq / (SELECT sum(freq) FROM f) > 0.002")
def corpus_stopwords(spark, sf_dir):
    return terms.frequent_terms(kept_counts(spark, sf_dir), 0.002).withColumn("share", F.round("share", 6))


@query(f"WITH {KEPT} SELECT doc_id AS doc FROM documents WHERE doc_id NOT IN (SELECT doc FROM kept)")
def drop_empty_docs(spark, sf_dir):
    return terms.lost_docs(docs(spark, sf_dir), "doc_id", kept_counts(spark, sf_dir))


@query(r"SELECT conv_id, turn, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]'))::BIGINT AS n_tokens, len(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]'), lambda x: regexp_matches(x, '^[A-Z]')))::BIGINT AS n_capital FROM conversations")
def punctuated_tokens(spark, sf_dir):
    toks = t.punctuated_tokens(F.col("text"))
    kept = F.filter(t.padded_select(toks, "^[A-Z]"), lambda x: x != "")
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(toks).cast("long").alias("n_tokens"), F.size(kept).cast("long").alias("n_capital"))


@query(r"""WITH tk AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]') AS ts FROM documents),
p AS (SELECT ts[i] AS w1, ts[i + 1] AS w2 FROM (SELECT ts, unnest(range(1, len(ts))) AS i FROM tk)),
b AS (SELECT w1, w2, count(*) AS n FROM p WHERE regexp_matches(w1, '^[A-Z]') AND regexp_matches(w2, '^[A-Z]') GROUP BY w1, w2),
m AS (SELECT *, sum(n) OVER (PARTITION BY w1) AS n1, sum(n) OVER (PARTITION BY w2) AS n2, sum(n) OVER () AS total FROM b),
c AS (SELECT w1, w2, n, n + 0.5::DOUBLE AS a, n1 - n + 0.5::DOUBLE AS bb, n2 - n + 0.5::DOUBLE AS cc, total - n1 - n2 + n + 0.5::DOUBLE AS d FROM m WHERE n >= 5)
SELECT w1, w2, n, round(ln(a) + ln(d) - ln(bb) - ln(cc), 6) AS lambda, round((ln(a) + ln(d) - ln(bb) - ln(cc)) / sqrt(1 / a + 1 / bb + 1 / cc + 1 / d), 6) AS z FROM c""")
def bigram_collocations(spark, sf_dir):
    found = terms.collocations(terms.adjacent_pairs(docs(spark, sf_dir), "doc_id", F.col("text")), 5)
    return found.select("w1", "w2", "n", F.round("lambda", 6).alias("lambda"), F.round("z", 6).alias("z"))


@query(rf"SELECT DISTINCT c AS collocate, replace(c, '_', ' ') AS phrase FROM (SELECT unnest(regexp_extract_all({_joined(clean('text'))}, '\b\w+_\w+\b')) AS c FROM documents)")
def phrase_features(spark, sf_dir):
    return terms.phrase_features(docs(spark, sf_dir), t.clean_text(F.col("text")), PHRASES)


@query(f"""WITH tk AS (SELECT doc_id AS doc, list_filter(string_split({clean('text')}, ' '), lambda x: x <> '') AS ts FROM documents),
u AS (SELECT doc, unnest(ts) AS term FROM tk UNION ALL SELECT doc, ts[i] || '_' || ts[i + 1] FROM (SELECT doc, ts, unnest(range(1, len(ts))) AS i FROM tk))
SELECT doc, term, count(*) AS n FROM u GROUP BY doc, term""")
def ngram_dtm(spark, sf_dir):
    return terms.ngram_counts(terms.doc_tokens(docs(spark, sf_dir), "doc_id", t.clean_text(F.col("text"))))


@query(f"WITH {TFIDF} SELECT doc, term, n, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tf * idf, 6) AS tf_idf FROM weights")
def tfidf(spark, sf_dir):
    return terms.tfidf(kept_counts(spark, sf_dir)).select("doc", "term", "n", *(F.round(c, 6).alias(c) for c in ("tf", "idf", "tf_idf")))


@query(f"WITH {TFIDF} SELECT doc, string_agg(term, ' ' ORDER BY round(tf * idf, 9) DESC, n DESC, term) AS keywords FROM weights GROUP BY doc")
def keywords_tfidf(spark, sf_dir):
    return terms.keywords_tfidf(docs(spark, sf_dir), "doc_id", t.clean_text(F.col("text")), stops(spark))


def _weighted(source: str, name: str) -> str:
    """CTEs of keywords by tf-idf of (doc, text) in ``source``."""
    return f"""{name}_t AS (SELECT doc, term, count(*) AS n FROM (SELECT doc, unnest(string_split(text, ' ')) AS term FROM {source}) WHERE term <> '' AND term NOT IN (SELECT * FROM {values(stop_list())}) GROUP BY doc, term),
{name}_w AS (SELECT doc, term, n, n / sum(n) OVER (PARTITION BY doc) AS tf, ln((SELECT count(DISTINCT doc) FROM {name}_t) / count(*) OVER (PARTITION BY term)) AS idf FROM {name}_t),
{name} AS (SELECT doc, string_agg(term, ' ' ORDER BY round(tf * idf, 9) DESC, n DESC, term) AS keywords FROM {name}_w GROUP BY doc)"""


@query(rf"""WITH base AS (SELECT doc, name, regexp_replace(j, '\b\w+_\w+\b', '', 'g') AS text, array_to_string(regexp_extract_all(j, '\b\w+_\w+\b'), '/') AS collocate
  FROM (SELECT doc_id AS doc, 'item ' || doc_id AS name, {_joined(clean('text'))} AS j FROM documents)),
{_weighted('base', 'first')},
merged AS (SELECT base.doc, string_split_regex(replace(coalesce(first.keywords, 'NA') || ' ' || collocate || ' ' || name, '_', ' '), '\s+') AS parts FROM base LEFT JOIN first USING (doc)),
deduped AS (SELECT doc, replace((SELECT string_agg(w, ' ' ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest(parts) AS w, generate_subscripts(parts, 1) AS p) GROUP BY w)), 'NA', '') AS s FROM merged),
again AS (SELECT doc, {clean('s')} AS text FROM deduped),
{_weighted('again', 'second')}
SELECT base.doc, base.text AS text_clean, base.collocate, coalesce(second.keywords, name) AS keywords FROM base LEFT JOIN second USING (doc) WHERE coalesce(second.keywords, name) <> ''""")
def two_pass_keywords(spark, sf_dir):
    name = F.concat(F.lit("item "), F.col("doc_id").cast("string"))
    return terms.two_pass_keywords(docs(spark, sf_dir), "doc_id", t.clean_text(F.col("text")), name, PHRASES, t.SEED_WORDS, stops(spark))


#: A small lexicon for the annotation query: form, lemma, part of speech.
LEXICON = (("the", "the", "DET"), ("is", "be", "VERB"), ("are", "be", "VERB"), ("was", "be", "VERB"), ("is", "be", "VERB"), ("and", "and", "CCONJ"), ("of", "of", "ADP"))


@query(f"""WITH lx AS (SELECT DISTINCT * FROM (VALUES {', '.join(map(str, LEXICON))}) AS v(form, lemma, upos))
SELECT doc, coalesce(lemma, term) AS lemma, coalesce(upos, 'NOUN') AS upos, count(*) AS n FROM ({tokens()}) LEFT JOIN lx ON form = term GROUP BY ALL""")
def pos_annotation(spark, sf_dir):
    lexicon = spark.createDataFrame(sorted(set(LEXICON)), "form string, lemma string, upos string")
    toks = terms.doc_tokens(docs(spark, sf_dir), "doc_id", t.clean_text(F.col("text")))
    return terms.annotate(toks, F.broadcast(lexicon)).groupBy("doc", "lemma", "upos").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH lx AS (SELECT DISTINCT * FROM (VALUES {', '.join(map(str, LEXICON))}) AS v(form, lemma, upos)),
tk AS (SELECT doc, ts[i] AS term, i FROM (SELECT doc, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id AS doc, list_filter(string_split({clean('text')}, ' '), lambda x: x <> '') AS ts FROM documents)))
SELECT doc, string_agg(coalesce(lemma, term), ' ' ORDER BY i) AS text FROM tk LEFT JOIN lx ON form = term WHERE coalesce(upos, 'NOUN') <> 'VERB' GROUP BY doc""")
def remove_verbs(spark, sf_dir):
    lexicon = spark.createDataFrame(sorted(set(LEXICON)), "form string, lemma string, upos string")
    return terms.remove_verbs(terms.doc_tokens(docs(spark, sf_dir), "doc_id", t.clean_text(F.col("text"))), F.broadcast(lexicon))


@query()
def stemmed_counts(spark, sf_dir):
    return terms.stemmed_counts(terms.doc_tokens(docs(spark, sf_dir), "doc_id", t.clean_text(F.col("text"))))


LISTED = r"""tk AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]') AS ts FROM documents),
p AS (SELECT ts[i] AS w1, ts[i + 1] AS w2 FROM (SELECT ts, unnest(range(1, len(ts))) AS i FROM tk)),
listed AS (SELECT list(phrase ORDER BY n DESC, phrase) AS phrases FROM (SELECT w1 || ' ' || w2 AS phrase, count(*) AS n FROM p WHERE regexp_matches(w1, '^[A-Z]') AND regexp_matches(w2, '^[a-z]') GROUP BY 1 HAVING count(*) >= 10))"""


@query(f"WITH {LISTED} SELECT doc_id, list_reduce(list_prepend(text, (SELECT phrases FROM listed)), lambda acc, x: replace(acc, x, replace(x, ' ', '_'))) AS joined FROM documents")
def listed_phrases(spark, sf_dir):
    """All documents with every pair of a capitalised word and its neighbour that occurs ten times or more joined, the commonest first."""
    toks = t.punctuated_tokens(F.col("text"))
    both = docs(spark, sf_dir).select(F.explode(F.arrays_zip(toks.alias("a"), F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0))).alias("b"))).alias("p"))
    found = both.select(F.col("p.a").alias("w1"), F.col("p.b").alias("w2")).filter(F.col("w1").rlike("^[A-Z]") & F.col("w2").rlike("^[a-z]"))
    counted = found.groupBy(F.concat_ws(" ", "w1", "w2").alias("phrase")).agg((-F.count(F.lit(1))).alias("n")).filter("n <= -10")
    return phrases.combine_listed(docs(spark, sf_dir).select("doc_id", "text"), "text", phrases.phrase_list(counted, ("n",))).select("doc_id", "joined")
