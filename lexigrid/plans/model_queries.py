"""Topic summaries and measures, splits, balancing, model persistence, curves, sheets and inspection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import evaluate as ev
from ..operators import models, report, terms, topics
from ..sources.bank import read_lexicon, read_sheet, read_table, write_csv, write_sheets, write_stage
from ..sources.stage import Stages
from .fragments import clean, tokens, values
from .pair_queries import BETA, SCORED, betas, scored_labels
from .registry import query
from .text_queries import LEXICON, docs, kept_counts, kept_tokens, stop_list


def _folder(spark) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/lexigrid-{uuid.uuid4().hex}"


# Stand-ins for a fitted model: the topics by terms of BETA, and the share of each of five topics in a document.
THETA = "theta AS (SELECT doc AS id, topic, g / sum(g) OVER (PARTITION BY doc) AS gamma FROM (SELECT doc, topic, 1 + (doc * 31 + topic * 17) % 7 AS g FROM (SELECT DISTINCT doc FROM kept), (SELECT unnest(range(1, 6))::INT AS topic)))"


def thetas(spark, sf_dir: str, counted=None):
    g = (kept_counts(spark, sf_dir) if counted is None else counted).select(F.col("doc").alias("id")).distinct().withColumn("topic", F.explode(F.sequence(F.lit(1), F.lit(5))))
    g = g.withColumn("g", 1 + (F.col("id") * 31 + F.col("topic") * 17) % 7)
    total = g.groupBy("id").agg(F.sum("g").alias("total"))
    return g.join(total, "id").select("id", "topic", (F.col("g") / F.col("total")).alias("gamma"))


COHERENCE = """top AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY beta DESC, term) AS r FROM beta QUALIFY r <= 5),
hit AS (SELECT DISTINCT topic, r, doc FROM top JOIN kept USING (term)), df AS (SELECT topic, r, count(*) AS n FROM hit GROUP BY 1, 2),
both_ AS (SELECT a.topic, a.r AS a, b.r AS b, count(*) AS n FROM hit a JOIN hit b ON a.topic = b.topic AND a.doc = b.doc AND a.r < b.r GROUP BY 1, 2, 3),
coh AS (SELECT x.topic, avg(coalesce(both_.n, 0) / x.n - y.n / (SELECT count(DISTINCT doc) FROM kept)) AS coherence
  FROM df x JOIN df y ON x.topic = y.topic AND x.r < y.r LEFT JOIN both_ ON both_.topic = x.topic AND both_.a = x.r AND both_.b = y.r GROUP BY 1)"""


@query(f"WITH {BETA}, {COHERENCE} SELECT topic::INT AS topic, round(coherence, 6) AS coherence FROM coh")
def topic_coherence(spark, sf_dir):
    return topics.coherence(kept_counts(spark, sf_dir), betas(spark, sf_dir)).withColumn("coherence", F.round("coherence", 6))


@query(f"""WITH {BETA}, {THETA}, {COHERENCE}, tk AS (SELECT doc, ts[i] AS term, i FROM (SELECT doc, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id AS doc, list_filter(string_split({clean('text')}, ' '), lambda x: x <> '') AS ts FROM documents)) WHERE ts[i] NOT IN (SELECT * FROM {values(stop_list())})),
grams AS (SELECT doc, a || '_' || b AS term, count(*) AS n FROM (SELECT doc, term AS a, lead(term) OVER (PARTITION BY doc ORDER BY i) AS b FROM tk) WHERE b IS NOT NULL GROUP BY 1, 2),
freq AS (SELECT topic, term, sum(n) AS n FROM theta JOIN grams ON id = doc WHERE gamma > 0.2 GROUP BY 1, 2), lab AS (SELECT topic, term AS label FROM freq QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) = 1),
prev AS (SELECT topic, sum(gamma) / (SELECT sum(gamma) FROM theta) * 100 AS prevalence FROM theta GROUP BY topic), tt AS (SELECT topic, string_agg(term, ', ' ORDER BY r) AS top_terms FROM top GROUP BY topic)
SELECT prev.topic::INT AS topic, label, round(coherence, 3) AS coherence, round(prevalence, 3) AS prevalence, top_terms FROM prev LEFT JOIN tt ON tt.topic = prev.topic LEFT JOIN coh ON coh.topic = prev.topic LEFT JOIN lab ON lab.topic = prev.topic ORDER BY prevalence DESC, prev.topic LIMIT 10""")
def topic_summary(spark, sf_dir):
    """Labels are neighbours in the texts once stop words are gone."""
    return topics.summary(betas(spark, sf_dir), thetas(spark, sf_dir), terms.ngram_counts(kept_tokens(spark, sf_dir)), least=0.2)


@query(f"WITH {BETA}, {THETA}, mixed AS (SELECT k.doc, k.term, any_value(k.n) AS n, sum(gamma * beta) AS p FROM kept k JOIN theta ON theta.id = k.doc JOIN beta ON beta.topic = theta.topic AND beta.term = k.term GROUP BY 1, 2) SELECT round(exp(-sum(n * ln(p)) / sum(n)), 4) AS perplexity FROM mixed")
def fixed_perplexity(spark, sf_dir):
    counted = Stages(spark, "kept").written(kept_counts(spark, sf_dir), "counts")
    return topics.perplexity(counted, thetas(spark, sf_dir, counted), betas(spark, sf_dir, counted)).select(F.round("perplexity", 4).alias("perplexity"))


@query(f"WITH {BETA}, nb AS (SELECT topic, sqrt(sum(beta * beta)) AS norm FROM beta GROUP BY topic), d AS (SELECT x.topic AS a, y.topic AS b, sum(x.beta * y.beta) AS dot FROM beta x JOIN beta y ON x.term = y.term AND x.topic < y.topic GROUP BY 1, 2) SELECT round(sum(coalesce(dot, 0) / (na.norm * n2.norm)) / count(*), 6) AS cao_juan FROM nb na JOIN nb n2 ON na.topic < n2.topic LEFT JOIN d ON a = na.topic AND b = n2.topic")
def cao_juan_measure(spark, sf_dir):
    return topics.mean_topic_cosine(betas(spark, sf_dir)).select(F.round("cao_juan", 6).alias("cao_juan"))


@query("SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY (doc_id * 7919) % 104729, doc_id) <= ceil(count(*) OVER (PARTITION BY toxic) * 70 / 100.0) AS is_train FROM labels")
def stratified_split(spark, sf_dir):
    return models.stratified_split(read_table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


@query(f"WITH {SCORED}, c AS (SELECT count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM scored) SELECT y, CASE WHEN y = 0 THEN n ELSE p + p * (CASE WHEN p >= 2 THEN greatest((n - p) // p, 0) ELSE 0 END) END::BIGINT AS n FROM c, (VALUES (0::INT), (1::INT)) AS v(y)")
def smote_counts(spark, sf_dir):
    balanced = models.smote(scored_labels(spark, sf_dir), ("score",), "y", ("doc_id",))
    return balanced.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n_rows, count(*) AS n_same FROM labels")
def model_round_trip(spark, sf_dir):
    """A fitted model saved, loaded again, and held against itself on every row."""
    rows, path = scored_labels(spark, sf_dir), f"{_folder(spark)}/model"
    model = models.fit_logit(rows, ("score",), "y")
    models.save_model(model, path)
    both = models.score(models.load_model(path), models.score(model, rows, "before"), "after")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("before") == F.col("after")).alias("n_same"))


@query(f"WITH {SCORED}, b AS (SELECT score AS threshold, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM scored WHERE y IS NOT NULL GROUP BY score) SELECT threshold, round(sum(p) OVER (ORDER BY threshold DESC) / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER (ORDER BY threshold DESC) / sum(n) OVER (), 6) AS fpr FROM b")
def roc_points(spark, sf_dir):
    points = ev.roc_points(scored_labels(spark, sf_dir), "y", "score")
    return points.select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(f"""WITH lx AS (SELECT DISTINCT * FROM (VALUES {', '.join(map(str, LEXICON))}) AS v(form, lemma, upos))
SELECT doc, coalesce(lemma, term) AS term, count(*) AS n FROM ({tokens()}) LEFT JOIN lx ON form = term WHERE coalesce(upos, 'NOUN') IN ('NOUN', 'ADJ') GROUP BY ALL""")
def pos_filter(spark, sf_dir):
    """The lexicon is written as a table and loaded; words it has as verbs, determiners and so on are left out."""
    path = f"{_folder(spark)}/lexicon"
    write_csv(spark.createDataFrame([(f.title(), m, u.lower()) for f, m, u in LEXICON], "form string, lemma string, upos string"), path)
    toks = terms.doc_tokens(docs(spark, sf_dir), "doc_id", t.clean_text(F.col("text")))
    kept = terms.annotate(toks, F.broadcast(read_lexicon(spark, path))).filter(F.col("upos").isin("NOUN", "ADJ"))
    return terms.counts(kept.select("doc", F.col("lemma").alias("term")))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sheet_round_trip(spark, sf_dir):
    """Two sheets of a workbook written, read again with their schemas and joined; the result is handed on as a stage."""
    n, r, path = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region"), _folder(spark)
    write_sheets({"nation": n, "region": r}, path)
    a, b = read_sheet(spark, path, "nation", n.schema), read_sheet(spark, path, "region", r.schema)
    return write_stage(a.join(F.broadcast(b), a["n_regionkey"] == b["r_regionkey"]).select("n_nationkey", "n_name", "r_name"), f"{path}/joined")


@query(f"WITH {SCORED} SELECT '(Intercept)' AS term, round(sum(y), 3) AS total FROM scored WHERE y IS NOT NULL UNION ALL SELECT 'score', round(sum(y * score), 3) FROM scored WHERE y IS NOT NULL")
def logit_moments(spark, sf_dir):
    """The score equations of the regression: at the fit the probabilities have the labels' sums, alone and times each feature."""
    rows = scored_labels(spark, sf_dir).filter("y is not null")
    fitted = models.score(models.fit_logit(rows, ("score",), "y"), rows, "p1")
    sums = fitted.agg(F.round(F.sum("p1"), 3).alias("a"), F.round(F.sum(F.col("p1") * F.col("score")), 3).alias("b"))
    return sums.select(F.inline(F.array(F.struct(F.lit("(Intercept)").alias("term"), F.col("a").alias("total")), F.struct(F.lit("score").alias("term"), F.col("b").alias("total")))))


PROFILED = ("doc_id", "text", "lang", "source", "n_chars")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{'bigint' if c in ('doc_id', 'n_chars') else 'string'}' AS data_type, count(*) AS n_rows, count(*) - count({c}) AS n_null FROM documents" for c in PROFILED))
def table_profile(spark, sf_dir):
    return report.profile(docs(spark, sf_dir).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")))


@query(f"WITH {SCORED} SELECT floor(score / 0.125) * 0.125 AS bin, count(*) AS n FROM scored WHERE score IS NOT NULL GROUP BY 1")
def score_histogram(spark, sf_dir):
    return report.histogram(scored_labels(spark, sf_dir), "score", 0.125)


# Iterative fits: no SQL form; the tests hold them against planted structure.


def _labelled(spark, sf_dir: str):
    return scored_labels(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id").filter("y is not null")


@query()
def forest_grid(spark, sf_dir):
    """The area under the curve of each of the twelve forests on the rows that the stratified split holds out."""
    rows = models.stratified_split(_labelled(spark, sf_dir), "y", "doc_id").cache()
    found = models.grid_search(rows.filter("is_train"), rows.filter("not is_train"), ("score", "n_chars"), "y")
    rows.unpersist()
    return spark.createDataFrame([(x["node_size"], x["trees"], x["auc"]) for x in found], "node_size int, trees int, auc double")


@query()
def repeated_cv(spark, sf_dir):
    rows = _labelled(spark, sf_dir).cache()
    found = models.repeated_cv(rows, ("score", "n_chars"), "y", "doc_id")
    rows.unpersist()
    return spark.createDataFrame([(x["repeat"], x["fold"], x["auc"]) for x in found], "repeat int, fold int, auc double")
