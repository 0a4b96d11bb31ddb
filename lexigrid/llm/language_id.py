"""Language ID by multilingual mixture inference.

Each language has letter n-gram frequencies learned from labelled texts. A document is a mixture: every word
comes from one language, with the likelihood of its n-grams. Expectation-maximisation estimates the shares of
the languages; the set of languages is the one with the best log likelihood less half a log of the number of
words for each further language (the Bayesian information criterion).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import but_text, carried, fields_of, fold_of, shielded, sliced, text_batches, utf8

UNKNOWN = "und"
#: ASCII that is no letter to a space; what is not ASCII stays.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def letter_words(text: str | None) -> list[bytes]:
    return utf8((text or "").lower()).translate(LETTERS).split()


def grams(word: bytes, n: int) -> Iterator[str]:
    w = f"^{word.decode('utf-8', 'replace')}$"
    for i in range(max(1, len(w) - n + 1)):
        yield w[i : i + n]


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    n: int = 3
    at: dict[str, int] = field(default_factory=dict)  # n-gram -> row of log_p
    log_p: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))  # the last row is for n-grams not seen

    @staticmethod
    def of(counts: list[tuple[str, str, int]], n: int, alpha: float = 0.5) -> LanguageModel:
        """From (language, n-gram, count), with additive smoothing."""
        languages = sorted({c[0] for c in counts})
        at = {g: i for i, g in enumerate(sorted({c[1] for c in counts}))}
        table = np.zeros((len(at) + 1, len(languages)))
        for lang, g, c in counts:
            table[at[g], languages.index(lang)] += c
        return LanguageModel(languages, n, at, np.log((table + alpha) / (table + alpha).sum(0))) if languages else LanguageModel(n=n)

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """Log likelihood of each word in each language."""
        if not words:
            return np.zeros((0, len(self.languages)))
        get, unseen = self.at.get, len(self.at)
        rows, starts = [], []
        for w in words:
            starts.append(len(rows))
            rows += [get(g, unseen) for g in grams(w, self.n)]
        return np.add.reduceat(self.log_p[rows], starts)


def mixture(logs: np.ndarray, times: np.ndarray, rounds: int = 40, near: float = 1e-3) -> tuple[np.ndarray, float]:
    """Shares by expectation-maximisation, and the log likelihood under them, of words that occur so many times."""
    top = logs.max(1, keepdims=True)
    if logs.shape[1] == 1:
        return np.ones(1), float(times @ top[:, 0])
    p = np.exp(logs - top)
    share = np.full(logs.shape[1], 1 / logs.shape[1])
    for _ in range(rounds):
        r = p * share
        new = times @ (r / r.sum(1, keepdims=True)) / times.sum()
        moved, share = np.abs(new - share).max(), new
        if moved < near:
            break
    return share, float(times @ (np.log(p @ share) + top[:, 0]))


def languages_of(logs: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the languages of the best set, their shares), the largest share first; the earlier language on a tie.

    logs has a row for each word, which occurs as often as times says, once if it is not given.
    """
    times = np.ones(len(logs)) if times is None else times
    whole, _ = mixture(logs, times)
    order = np.argsort(-whole, kind="stable")
    best = None
    for k in range(1, len(order) + 1):
        share, fit = mixture(logs[:, order[:k]], times)
        fit -= 0.5 * (k - 1) * np.log(times.sum())
        if best is not None and fit <= best[0]:
            break
        best = (fit, order[:k], share)
    _, chosen, share = best
    by = np.argsort(-share, kind="stable")
    return chosen[by], share[by]


def _counted(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for b in sliced(batches, "text"):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(letter_words(text))
        for lang, seen in words.items():
            found: Counter = Counter()
            for w, c in seen.items():
                for g in grams(w, n):
                    found[g] += c
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "c"])

    return run


def fit_languages(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n: int = 3, max_docs: int = 3_000, max_grams: int = 20_000) -> LanguageModel:
    """n-gram frequencies from at most max_docs labelled texts a language (the first by a hash of the id), max_grams n-grams each.

    All n-grams of the sample are counted; the most frequent of each language stay, ties by code point.
    """
    from pyspark.sql import Window

    text_batches(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), (F.lit(True) if usable is None else usable).alias("ok")).filter("ok and lang is not null")
    key = F.xxhash64("id")
    # A first cut by the hash, from the count of each language, keeps the window small whatever the input.
    sizes = known.groupBy("lang").count()
    near = known.join(F.broadcast(sizes), "lang").filter(F.pmod(key, F.lit(1_000_003)) <= F.ceil(F.lit(1_000_003.0) * 2 * max_docs / F.col("count")))
    ids = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(key, F.lit(1_000_003)), "id"))).filter(F.col("r") <= max_docs).select("id", "lang").distinct()
    text = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(ids), ["id", "lang"], "left_semi")
    counts = text.repartition(16).mapInArrow(_counted(n), "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "gram"))).filter(F.col("r") <= max_grams)
    return LanguageModel.of([(r.lang, r.gram, r.c) for r in top.collect()], n)


class _Words:
    """Log likelihoods of words, remembered for up to ``most`` of them."""

    def __init__(self, model: LanguageModel, most: int):
        self.model, self.most = model, most
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((1 << 14, len(model.languages)))

    def add(self, words: list[Counter]) -> None:
        if len(self.at) > self.most:
            self.at.clear()
        new = sorted(set().union(*words) - self.at.keys())
        start, end = len(self.at), len(self.at) + len(new)
        if end > len(self.rows):
            self.rows = np.concatenate([self.rows[:start], np.zeros((2 * end - start, self.rows.shape[1]))])
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            self.rows[start + i : start + i + len(part)] = self.model.of_words(part)
        self.at.update(zip(new, range(start, end), strict=True))

    def of(self, words: Counter) -> np.ndarray:
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


@shielded
def language_id(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None, memo_words: int = 200_000) -> DataFrame:
    """The columns ``keep`` (all but the text if not given) with lang_pred, score and langs.

    langs: the chosen languages with their shares, the largest first; lang_pred and score are the first of
    them. Words are told apart once a text, with their counts, so a long text takes what its distinct words take.
    A null text, one without a letter, or a model without languages gives und, 0 and no langs. Repeated
    rows get the same; columns of these names are replaced.
    """
    base, names, body = carried(docs, text_col, but_text(docs, text_col, keep), ("lang_pred", "score", "langs"))
    result = T.StructType().add("lang_pred", "string").add("score", "double").add("langs", T.MapType(T.StringType(), T.DoubleType()))

    def one(text: str | None, words: Counter, known: _Words) -> tuple:
        if not model.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, []
        which, share = languages_of(known.of(words), np.fromiter(words.values(), float, len(words)))
        return model.languages[which[0]], float(share[0]), [(model.languages[i], float(s)) for i, s in zip(which, share, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(model, memo_words)
        for b in sliced(batches, body):
            texts = b.column(body).to_pylist()
            words = [Counter(letter_words(t)) for t in texts]
            known.add(words)
            found = [one(t, w, known) for t, w in zip(texts, words, strict=True)]
            cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *cols], [*names, *result.names])

    return base.mapInArrow(run, T.StructType(fields_of(base, names) + result.fields))


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of the ids whose languages are never read."""
    return F.coalesce(fold_of(F.col(id_col), 4) == 2, F.lit(False))
