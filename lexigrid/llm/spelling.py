"""Spelling variants by a rare-first q-gram prefix filter.

Two words are near if they differ by one inserted, deleted or replaced code point. One edit touches at most two of a
word's bigrams; the others stand in both words in the same order, at the same place or one further. Bigrams are ordered
by their frequency among all words, then by the bigram, and those of one word that are equal by their place. In either
word at most two bigrams come before the first that they share, and it is the same in both: so near words share one of
their three rarest, at places at most one apart, and nothing else needs to be compared.

The edit lies on one side of the shared bigram, so what stands on the other side is equal, and so is one half of what
stands on its own side: the join is on these too, by a hash, which splits the bucket of a frequent bigram and fixes the
places. What meets is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs_of(docs: DataFrame, id_col: str, text_col: str, pattern: str = LETTERS) -> DataFrame:
    """(id, run): every run of letters of every text, A-Z lowered."""
    runs = F.regexp_extract_all(F.translate(F.col(f"`{text_col}`"), UPPER, LOWER), F.lit(pattern), F.lit(0))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))


def mistyped(runs: DataFrame, every: int = 97) -> Column:
    """The run, without one code point where ``every`` divides the crc32 of <id>:<run>."""
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))


def rarest_bigrams(words: DataFrame, scratch: Scratch, most: int = 3, broadcast_rows: int = 65_536) -> DataFrame:
    """(word, gram, place): the bigrams of each word that are the rarest among all words; place from 0.

    The frequencies are at most as many as pairs of letters, 8,100 of the given alphabet; up to ``broadcast_rows`` they are broadcast, beyond it joined by a shuffle.
    """
    bigrams = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("place", "gram")
    counts = scratch.written(words.select(bigrams).groupBy("gram").agg(F.count(F.lit(1)).alias("rank")), "bigrams")
    grams = words.select("word").repartition("word").select("word", bigrams)
    ranked = grams.join(F.broadcast(counts) if counts.count() <= broadcast_rows else counts, "gram")
    kept = ranked.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("rank", "gram", "place"))).alias("grams"))  # a word's own bigrams
    return kept.select("word", F.explode(F.slice("grams", 1, most)).alias("g")).select("word", "g.gram", "g.place")


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), each pair of near words once, the shorter or smaller one first; words (word) are distinct and have three bigrams or more."""
    grams = rarest_bigrams(words, scratch)
    w, n, at = F.col("word"), F.length("word"), F.col("place")
    part = lambda start, length: F.substring(w, start + 1, length)
    # (side, what is equal with the bigram, where the rest with the edit begins, its length)
    sides = ((0, part(F.lit(0), at + 2), at + 2, n - at - 2), (1, part(at, n), F.lit(0), at))

    def keys(longer: int, own: int) -> list[Column]:
        """For pairs of one length (longer 0) or of lengths one apart (1); own 1 on the side of the longer word, whose rest has one code point more."""
        out = []
        for side, known, start, rest in sides:
            m = rest - own
            h = F.floor(m / 2).cast("int")
            for half, text in ((0, part(start, h)), (1, part(start + own + h, m - h))):
                out.append(F.when(m >= 0, F.xxhash64(F.lit(4 * longer + 2 * side + half), n - own, known, text)))
        return out

    dealt = lambda name, *lists: grams.select(w.alias(name), F.explode(F.array_distinct(F.array_compact(F.array(*lists)))).alias("key"))
    met = dealt("a", *keys(0, 0), *keys(1, 0)).join(dealt("b", *keys(0, 0), *keys(1, 1)), "key")
    met = met.filter(((F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b").distinct()


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) from (word, form), where every word has a form and chains end: pointers are doubled until all point to an end."""
    at = scratch.written(forms.select("word", F.col("form").alias("root")), "pointers")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.written(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "pointers")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def spelling_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) from distinct words with their counts (word, n).

    form is the near word of largest n (ties: the smallest in code-point order) if that n is at least ``times`` the word's
    (over 1, so that chains of forms end), else null; root is the end of the chain. Words without a near word have n_near 0 and are their own root. Words of
    fewer than four code points end the job: their bigrams do not bear the filter. An empty table gives an empty one.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    short = F.assert_true(F.length("word") > 3, F.lit("words of fewer than four code points"))
    words = scratch.written(words.select("word", F.col("n").cast("long").alias("n")).filter(short.isNull()), "words")
    pairs = scratch.written(near_pairs(words.select("word"), scratch), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    best = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best"))
    has_form = -F.col("best.m") >= times * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best.w")).alias("form"), F.when(has_form, -F.col("best.m")).alias("form_n"))
    found = scratch.written(found, "forms")
    ends = roots(found.filter("form is not null").select("word", "form"), scratch)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3, every: int = 97) -> DataFrame:
    """(word, n): the words of all whole texts, one in ``every`` of a document's distinct ones mistyped by its hash.

    A null or empty text has none; a null id is an empty one; rows that repeat count each; other columns are not read.
    """
    runs = runs_of(docs, id_col, text_col)
    words = runs.select(mistyped(runs, every).alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))
