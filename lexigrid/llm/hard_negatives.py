"""Hard negatives by blocked dense products.

Vectors are whole numbers. Anchors are dealt into rounds of a bounded number of bytes; the anchors of a round are
broadcast in blocks, and every task holds its share of all rows against them, a block of rows at a time, by a matrix
product in float64. Products and sums of whole numbers are exact there up to 2^53, which the norms bound beforehand;
where they don't, the product is taken in 64-bit integers.

The first pass keeps, for each anchor, its best rows of the same label; a task's best and those of others merge by the
same order, so tasks give only a few rows an anchor. The second pass takes the windows of scores that the positives set
and keeps the best rows of other labels in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as double; null if the vector or a component is null, NaN or infinite."""
    x = vector.cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(good, F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))))


class Best:
    """For each anchor the best k (score, id), higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), NONE), np.full((n, k), LAST)

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merges what ``scores`` (for each of the rows, NONE where there is nothing) has; ids ascend along its columns."""
        k = self.score.shape[1]
        some = scores.max(axis=1, initial=NONE) if scores.shape[1] else np.full(len(rows), NONE)
        alive = np.flatnonzero((some > NONE) & (some >= self.score[rows, k - 1]))
        if not len(alive):
            return
        scores, at = scores[alive], np.arange(len(alive))
        new_s, new_i = np.full((len(alive), k), NONE), np.full((len(alive), k), LAST)
        for j in range(min(k, scores.shape[1])):
            best = scores.argmax(axis=1)  # the first of equal ones, so the smallest id
            new_s[:, j], new_i[:, j] = scores[at, best], ids[best]
            scores[at, best] = NONE
        new_i[new_s == NONE] = LAST
        both_s, both_i = np.hstack([self.score[rows[alive]], new_s]), np.hstack([self.id[rows[alive]], new_i])
        order = np.lexsort((both_i, -both_s.clip(NONE + 1)), axis=1)[:, :k]
        self.score[rows[alive]], self.id[rows[alive]] = np.take_along_axis(both_s, order, 1), np.take_along_axis(both_i, order, 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    norm = lambda m: max((float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max()))), 0.0) if m.size else 0.0
    bound = norm(a) * norm(b)
    if bound < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return a @ b.T
    raise ValueError("inner products of these vectors do not fit into 64 bits")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(matrix, vec_id, uid, label) of up to ``size`` rows of one length, ordered by vec_id."""
    for b in batches:
        lists, (ids, uids, labels) = b.column("q"), (b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "uid", "label"))
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        lengths = np.diff(ends)
        for dim in np.unique(lengths):
            mine = np.flatnonzero(lengths == dim)
            mine = mine[np.argsort(ids[mine], kind="stable")]
            for i in range(0, len(mine), size):
                at = mine[i : i + size]
                yield values[ends[at][:, None] + np.arange(dim)], ids[at], uids[at], labels[at]


class Anchors:
    """The anchors of a round, in blocks of one vector length; windows: (lowest, highest score) for each positive, if there are any."""

    def __init__(self, rows: pa.Table, size: int, windows: np.ndarray | None = None):
        rows = rows.sort_by("uid").combine_chunks()
        self.uid = rows.column("uid").to_numpy()
        self.label = rows.column("label").to_numpy()
        lists = rows.column("q").combine_chunks()
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        lengths = np.diff(ends)
        self.blocks = [(at, values[ends[at][:, None] + np.arange(dim)]) for dim in np.unique(lengths) for mine in [np.flatnonzero(lengths == dim)] for i in range(0, len(mine), size) for at in [mine[i : i + size]]]
        self.windows = windows

    def against(self, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of anchors, their scores) for every block of the same length."""
        for at, block in self.blocks:
            if block.shape[1] == matrix.shape[1]:
                yield at, products(block, matrix)


def _positives(anchors: Broadcast, k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchors.value
        best = Best(len(a.uid), k)
        for matrix, ids, uids, labels in _blocks(batches, size):
            for at, scores in a.against(matrix):
                scores[(a.label[at][:, None] != labels) | (a.uid[at][:, None] == uids)] = NONE
                best.take(at, scores, ids)
        row, col = np.nonzero(best.score > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(a.uid[row]), pa.array(best.id[row, col]), pa.array(best.score[row, col])], ["uid", "positive_id", "positive_score"])

    return run


def _negatives(anchors: Broadcast, k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchors.value
        each = a.windows.shape[1]
        best = [Best(len(a.uid), k) for _ in range(each)]
        for matrix, ids, _, labels in _blocks(batches, size):
            for at, scores in a.against(matrix):
                scores[a.label[at][:, None] == labels] = NONE
                for j in range(each):
                    low, high = a.windows[at, j, 0][:, None], a.windows[at, j, 1][:, None]
                    best[j].take(at, np.where((scores >= low) & (scores <= high), scores, NONE), ids)
        for j in range(each):
            row, col = np.nonzero(best[j].score > NONE)
            yield pa.RecordBatch.from_arrays([pa.array(a.uid[row]), pa.array(np.full(len(row), j + 1, np.int32)), pa.array(best[j].id[row, col]), pa.array(best[j].score[row, col])], ["uid", "place", "negative_id", "negative_score"])

    return run


def window_of(score: np.ndarray, least_percent: int, most_percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest n with least_percent * score <= 100 * n <= most_percent * score."""
    tens, rest = np.divmod(score, 100)
    return least_percent * tens - (-least_percent * rest // 100), most_percent * tens + most_percent * rest // 100


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 3, least_percent: int = 50, most_percent: int = 95, scale: int = 256, round_bytes: int = 32 << 20, block: int = 1_024) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor, positive and rank from 1.

    ``is_anchor`` and ``label`` (the column label if not given) are over the columns of ``vectors``; other columns are
    not read. Rows with a null id, label or vector, or a null or non-finite component, take no part. Only vectors of
    one length meet; empty ones have a score of 0 with each other. Repeated rows are rows of their own: each is
    listed, and an anchor's copy is another row. Ties go to the smaller id. An anchor without positives, and a positive
    without negatives, has no row; an empty table gives an empty one. Vectors whose products could pass 64 bits end
    the job with a ValueError.

    A round holds some ``round_bytes`` of anchors with their best rows, on the driver and in each task; all rows are read
    twice a round.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    picked = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), whole_numbers(F.col(f"`{vector_col}`"), scale).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = scratch.written(picked.dropna(subset=["vec_id", "label", "q"]).withColumn("uid", F.monotonically_increasing_id()), "rows")
    n, dim = rows.filter("anchor").agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    per = max(1, round_bytes // (8 * dim + 16 * positives * (negatives + 2)))
    rounds = -(-n // per)
    anchors = scratch.written(rows.filter("anchor").withColumn("round", F.pmod(F.xxhash64("uid"), F.lit(max(1, rounds)))), "anchors")
    best_first = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id")
    best_negative = Window.partitionBy("uid", "place").orderBy(F.desc("negative_score"), "negative_id")
    done = None
    for r in range(rounds):
        mine = anchors.filter(F.col("round") == r).select("uid", "label", "q").toArrow()  # some round_bytes
        if not mine.num_rows:
            continue
        first = Anchors(mine, block)
        sent = spark.sparkContext.broadcast(first)
        found = rows.mapInArrow(_positives(sent, positives, block), "uid long, positive_id long, positive_score long")
        found = scratch.written(found.withColumn("place", F.row_number().over(best_first)).filter(F.col("place") <= positives), f"positives-{r}")
        kept = found.select("uid", "place", "positive_score").toArrow()
        windows = np.empty((len(first.uid), positives, 2), np.int64)
        windows[..., 0], windows[..., 1] = LAST, NONE  # no score lies in it
        at = np.searchsorted(first.uid, kept.column("uid").to_numpy()), kept.column("place").to_numpy() - 1
        windows[at[0], at[1], 0], windows[at[0], at[1], 1] = window_of(kept.column("positive_score").to_numpy(), least_percent, most_percent)
        second = spark.sparkContext.broadcast(Anchors(mine, block, windows))
        lists = rows.mapInArrow(_negatives(second, negatives, block), "uid long, place int, negative_id long, negative_score long")
        lists = lists.withColumn("rank", F.row_number().over(best_negative)).filter(F.col("rank") <= negatives)
        own = anchors.filter(F.col("round") == r).select("uid", F.col("vec_id").alias("anchor_id"))
        out = scratch.written(lists.join(found, ["uid", "place"]).join(own, "uid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), f"negatives-{r}")
        scratch.drop(found)
        sent.destroy()
        second.destroy()
        done = out if done is None else done.unionByName(out)
    if done is None:
        done = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return done


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Every anchor of the whole table."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, label)


OP12_SQL = """
WITH rows AS (
  SELECT rowid AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q
  FROM (SELECT row_number() OVER () AS rowid, * FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.uid, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.uid <> b.uid AND len(a.q) = len(b.q)
), positives AS (
  SELECT uid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS place FROM scores WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.uid, p.place ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.uid = p.uid AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
