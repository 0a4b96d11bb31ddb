"""Host-level quality rules, in DataFrame functions alone.

Each text is held against plain rules. The failures are added up by host; a beta prior fitted to all hosts
by the method of moments shrinks each host's rate towards the common one, the more the fewer its documents.
A host whose shrunk rate lies beyond what the prior lets expect loses all its documents: over the prior's mean
by ``deviations`` of its standard deviations, but in no case below ``least_rate`` nor above ``max_rate``.

The words of a text, their hashes and their places are arrays of one row: a task needs some 60 bytes for each
word of its longest text (1 GB for a text of 100 MB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, shielded, table, words_of, written


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the array.

    Windows are compared by a 64-bit hash of their words. Sorting (hash, place) brings equal windows
    together, in n log n steps for a text of n words.
    """

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, j: x["h"].eqNullSafe(F.get(s, j)["h"])
        twice = let(pairs, lambda s: F.transform(F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)), lambda x: x["i"]))
        return let(twice, lambda q: F.size(F.array_distinct(F.flatten(F.array(q, F.transform(q, lambda i: i + 1), F.transform(q, lambda i: i + 2))))))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(count).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measured(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """docs without its text, with the counts and base_failed; a null or empty text counts 0 everywhere and fails by its few words."""
    text = F.col(text_col)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    with_words = docs.select(*rest, text.alias("__text"), words_of(text).alias("__words"))
    out = with_words.select(
        *rest,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("__text", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("__text")).alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_rates(rows: DataFrame, host_col: str, deviations: float = 3.0, least_rate: float = 0.25, max_rate: float = 0.5) -> DataFrame:
    """(host, docs, failures, rate, limit): rate is the posterior mean under the beta prior fitted to all hosts.

    With m the common rate and S the sum of n (f/n - m)^2 over the hosts, the intra-host correlation is
    (S / (m (1 - m)) - (H - 1)) / (N - sum n^2 / N - (H - 1)), held between 1e-6 and 1; the prior weighs as
    many documents as its inverse less one, and its variance is m (1 - m) times the correlation.
    """
    hosts = rows.filter(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("docs"), F.count_if("base_failed").alias("failures"))
    n, f = F.col("docs").cast("double"), F.col("failures").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).cast("double").alias("hn"), F.sum(n).alias("sn"), F.sum(f).alias("sf"), F.sum(n * n).alias("snn"), F.sum(f * f / n).alias("sff"))
    m = F.col("sf") / F.col("sn")
    spread = F.try_divide(F.col("sff") - F.col("sf") * m, m * (1 - m)) - (F.col("hn") - 1)
    rho = F.try_divide(spread, F.col("sn") - F.col("snn") / F.col("sn") - (F.col("hn") - 1))
    sums = sums.select(m.alias("m"), F.least(F.greatest(F.coalesce(rho, F.lit(1e-6)), F.lit(1e-6)), F.lit(1.0)).alias("rho"))
    limit = F.least(F.lit(max_rate), F.greatest(F.lit(least_rate), F.col("m") + deviations * F.sqrt(F.col("m") * (1 - F.col("m")) * F.col("rho"))))
    prior = sums.select("m", (1 / F.col("rho") - 1).alias("weight"), limit.alias("limit"))
    # One row against the hosts.
    return hosts.join(F.broadcast(prior), F.lit(True)).select("host", "docs", "failures", ((f + F.col("m") * F.col("weight")) / (n + F.col("weight"))).alias("rate"), "limit")


@shielded
def quality_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text", deviations: float = 3.0, least_rate: float = 0.25, max_rate: float = 0.5) -> DataFrame:
    """docs without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate and kept.

    kept: the text passes and its host's rate is at most the limit. A row without a host is judged by itself.
    Repeated rows count each; columns of these names are replaced; an empty table gives an empty one.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept")
    rows = written(measured(docs.drop(*new), text_col), "quality")
    rates = host_rates(rows, host_col, deviations, least_rate, max_rate).select(F.col("host").alias("__host"), F.col("rate").alias("host_rate"), "limit")
    # The hot hosts are on the left: a join that the optimizer may split by their rows.
    rates = rates.withColumn("__fits", F.col("host_rate") <= F.col("limit")).drop("limit")
    out = rows.join(rates, rows[host_col] == F.col("__host"), "left").drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce("__fits", F.lit(True))).drop("__fits")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), tri AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), dup AS (
  SELECT doc_id, i FROM tri JOIN (SELECT doc_id, g FROM tri GROUP BY doc_id, g HAVING count(*) >= 2) USING (doc_id, g)
), rep AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM dup, (VALUES (0), (1), (2)) AS x(d) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source
), s AS (
  SELECT count(*)::DOUBLE AS hn, sum(n) AS sn, sum(f) AS sf, sum(n * n) AS snn, sum(f * f / n) AS sff, sum(f) / sum(n) AS m FROM h
), q AS (
  SELECT m, least(greatest(coalesce(((sff - sf * m) / nullif(m * (1 - m), 0) - (hn - 1)) / nullif(sn - snn / sn - (hn - 1), 0), 1e-6), 1e-6), 1.0) AS rho FROM s
), p AS (
  SELECT m, 1 / rho - 1 AS weight, least(0.5, greatest(0.25, m + 3.0 * sqrt(m * (1 - m) * rho))) AS lim FROM q
), r AS (
  SELECT source, (f + m * weight) / (n + weight) AS rate, lim FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate <= lim, true) AS kept, round(rate, 6) AS host_rate
FROM b LEFT JOIN r USING (source)
"""
