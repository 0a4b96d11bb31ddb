"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives P; a sample of all texts is the unlabelled set U, whose labels are
not read. A linear classifier f over the words of a text and their beginnings minimises

    prior * mean_P loss(f)  +  max(0, mean_U loss(-f) - prior * mean_P loss(-f))

with the logistic loss. Where the second term goes below zero the step descends on its negation alone, as
the method has it, so that the classifier can't fit U by calling hidden positives negative.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, but_text, carried, fields_of, fold_of, shielded, sliced, text_batches, utf8

#: ASCII letters lowered, other ASCII to a space; bytes of non-ASCII letters stay.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def features(text: str | None) -> set[bytes]:
    """The distinct words of a text, with their beginnings of four and five bytes marked by a leading ^."""
    words = set(utf8(text).translate(LETTERS).split())
    heads = {w[:5] for w in words if len(w) > 5}
    return words | {b"^" + h for h in heads} | {b"^" + h[:4] for h in heads}


@dataclass
class ToxicityModel:
    bias: float = -20.0
    weights: dict[bytes, float] = field(default_factory=dict)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        known, get = self.weights.keys(), self.weights.__getitem__
        z = np.array([sum(map(get, known & features(t))) for t in texts], float) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(counts: Iterable[tuple[bytes, int, int]], p: int, u: int, min_z: float, most: int) -> list[bytes]:
    """Of (feature, texts of P with it, texts of U with it), those whose share of P lies min_z standard errors above their share of U; the rest is noise to a linear model."""
    found = []
    for w, k, j in counts:
        both = (k + j) / (p + u)
        z = (k / p - j / u) / max(1e-12, float(np.sqrt(both * (1 - both) * (1 / p + 1 / u))))
        if z >= min_z:
            found.append((-z, w))
    return [w for _, w in sorted(found)[:most]]


def train(vocabulary: list[bytes], positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 400, rate: float = 0.05, decay: float = 1e-5) -> ToxicityModel:
    """Fits the risk above by full-batch Adam on texts given as numbers of the vocabulary; deterministic. Without positives or unlabelled texts every score is near 0."""
    if not positive or not unlabelled:
        return ToxicityModel()
    docs = [*positive, *unlabelled]
    cols = np.concatenate(docs).astype(np.int32)
    rows = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
    p, n = len(positive), len(docs)
    w, b = np.zeros(len(vocabulary)), -1.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    for step in range(1, epochs + 1):
        z = np.bincount(rows, w[cols], n) + b
        s = sigmoid(z)
        risk = loss(-z[p:]).mean() - prior * loss(-z[:p]).mean()
        g = np.zeros(n)
        negative = np.concatenate([-prior * s[:p] / p, s[p:] / (n - p)])  # gradient of the second term
        if risk >= 0:
            g[:p] = -prior * (1 - s[:p]) / p
            g += negative
        else:
            g -= negative
        gw = np.bincount(cols, g[rows], len(w)) + decay * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    return ToxicityModel(float(b), {x: float(y) for x, y in zip(vocabulary, w, strict=True) if abs(y) > 1e-3})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, texts of P, texts of U) of a partition of the sample."""
    in_p: Counter = Counter()
    in_u: Counter = Counter()
    for b in sliced(batches, "text"):
        for text, p, u in zip(*(b.column(c).to_pylist() for c in ("text", "is_p", "is_u")), strict=True):
            found = features(text)
            if p:
                in_p.update(found)
            if u:
                in_u.update(found)
    both = list(in_p | in_u)
    for i in range(0, len(both), 50_000):
        part = both[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([in_p[w] for w in part], pa.int64()), pa.array([in_u[w] for w in part], pa.int64())], ["feature", "p", "u"])


def _numbered(vocabulary: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(vocabulary)}
        for b in sliced(batches, "text"):
            rows = [np.array(sorted(at[w] for w in at.keys() & features(t)), np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("is_p"), b.column("is_u"), pa.array(rows, pa.binary())], ["is_p", "is_u", "v"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_positive: int = 10_000, max_unlabelled: int = 20_000, min_docs: int = 3, min_z: float = 4.5, max_features: int = 60_000) -> ToxicityModel:
    """Trains on at most max_positive confirmed toxic texts and max_unlabelled texts, both the first by a hash of their id.

    ``usable``: which rows of labels may be read. The class prior is the share of toxic ones among them.
    """
    text_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic"), (F.lit(True) if usable is None else usable).alias("ok")).filter("ok and toxic is not null and id is not null")
    prior, rows = known.agg(F.avg((F.col("toxic") == 1).cast("double")), F.count(F.lit(1))).first()
    by_hash = [F.xxhash64("id"), F.col("id")]
    p = known.filter("toxic = 1").select("id").distinct().orderBy(*by_hash).limit(max_positive)
    u = docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct().orderBy(*by_hash).limit(max_unlabelled)
    ids = p.withColumn("is_p", F.lit(True)).withColumn("is_u", F.lit(False)).unionByName(u.withColumn("is_p", F.lit(False)).withColumn("is_u", F.lit(True)))
    ids = ids.groupBy("id").agg(F.max("is_p").alias("is_p"), F.max("is_u").alias("is_u"))  # max_positive + max_unlabelled rows at most
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id"), "sample").select("text", "is_p", "is_u")
    n_p, n_u = (int(x or 0) for x in sample.agg(F.sum(F.col("is_p").cast("long")), F.sum(F.col("is_u").cast("long"))).first())
    if not rows or not n_p or not n_u:
        return ToxicityModel()
    counts = sample.mapInArrow(_counted, "feature binary, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    counts = counts.filter((F.col("p") >= min_docs) & (F.col("p") / F.lit(n_p) > F.col("u") / F.lit(n_u)))
    vocabulary = telling(((bytes(r.feature), r.p, r.u) for r in counts.toLocalIterator()), n_p, n_u, min_z, max_features)
    rows = sample.mapInArrow(_numbered(vocabulary), "is_p boolean, is_u boolean, v binary").collect()
    scratch.clear()
    vectors = sorted((bytes(r.v), r.is_p, r.is_u) for r in rows)
    read = lambda v: np.frombuffer(v, np.int32)
    return train(vocabulary, [read(v) for v, p, _ in vectors if p], [read(v) for v, _, u in vectors if u], float(prior))


@shielded
def toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text if not given) with score, from 0 to 1, and predicted, 1 from the threshold on.

    The whole text is scored; a null or empty one gets the score of no words. Repeated rows score alike;
    columns named score or predicted are replaced.
    """
    base, names, body = carried(docs, text_col, but_text(docs, text_col, keep), ("score", "predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, body):
            scores = model.scores(b.column(body).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    out = T.StructType(fields_of(base, names) + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return base.mapInArrow(run, out)


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the ids whose labels are never read."""
    return F.coalesce(fold_of(F.col(id_col), 3) == 1, F.lit(False))
