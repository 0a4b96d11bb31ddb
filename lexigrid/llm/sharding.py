"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Count the rows of each input partition.
2. On the driver, draw how many rows each partition sends to each shard: row by row of the matrix a
   multivariate hypergeometric draw from what the shards still have room for. So the shard sizes are exact.
3. Permute each partition locally (a sort by a hash of the row's place); the row at place r of its permutation goes to the shard
   in whose range of the partition's matrix row r lies.
4. Exchange, and permute again inside the shard. A shard is dealt into cells at random and each cell is
   ordered at random, so no task holds a shard; the cells' sizes give the place of each cell.

The count of a cell follows from the matrix and the hash alone, so that no second pass over the texts is
needed. The input must list its rows alike when read again, as files do (see ``stable``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shielded, table, written

LIMIT = 10**9  # beyond it numpy draws no hypergeometric numbers


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Exact draw at any size: beyond numpy's limit by inversion over 40 standard deviations around the mode."""
    if good + bad < LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    total = good + bad
    mode = min(high, max(low, ((n + 1) * (good + 1)) // (total + 2)))
    reach = int(40 * np.sqrt(n * (good / total) * (bad / total) * max(1e-12, (total - n) / (total - 1)))) + 50
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=float)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max())
    return a + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum()))


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """rows[i] from partition i, shards[j] to shard j, uniformly over all ways to deal distinct rows; the sums must agree."""
    rng, room, matrix = np.random.default_rng(seed), list(shards), []
    for n in rows:
        left, rest, sent = n, sum(room), []
        for j, m in enumerate(room):
            rest -= m
            k = hypergeometric(rng, m, rest, left) if left and m else 0
            k = left if j == len(room) - 1 else k
            sent.append(k)
            left -= k
        room = [m - k for m, k in zip(room, sent, strict=True)]
        matrix.append(sent)
    return matrix


def _placed(rows: DataFrame, plan: DataFrame, seed: int, cells: int) -> DataFrame:
    """Adds to rows their input partition, place in its permutation, shard, cell and order in the cell."""
    rows = rows.withColumn("__id", F.monotonically_increasing_id())
    rows = rows.withColumns({"__p": F.shiftright("__id", 33), "__r": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    rows = rows.join(F.broadcast(plan), "__p", "left")
    shard = F.size(F.filter("__ends", lambda end: end <= F.col("__r")))
    known = F.coalesce(F.col("__r") < F.element_at("__ends", -1), F.lit(False))
    shard = F.when(known, shard).otherwise(F.raise_error(F.lit("the input listed other rows when read again; pass stable=False")).cast("int"))
    rows = rows.withColumns({"__shard": shard, "__order": F.xxhash64(F.lit(seed + 1), "__p", "__r")})
    return rows.withColumn("__cell", F.pmod("__order", F.lit(cells)).cast("int"))


@shielded
def shard_rows(docs: DataFrame, n_shards: int = 8, seed: int = 0, stable: bool = False, max_sources: int = 65_536, cell_rows: int = 4_096, max_cells: int = 8_192) -> DataFrame:
    """All rows and columns of docs with shard (int from 0) and slot (long, gapless from 0 in each shard).

    Shards differ by one row at most; which rows share a shard, and their order, is uniform at random for the
    seed. Nulls, empty texts, repeated rows and any further columns are carried along; columns named shard or
    slot are replaced; an empty table gives an empty one. ``stable``: docs lists its rows alike each time it
    is read (files); else it is first written to the shared folder. The matrix has at most max_sources rows,
    the table of cells n_shards * max_cells.
    """
    docs = docs.drop("shard", "slot")
    if not stable:
        docs = written(docs, "shard-input")
    spark = docs.sparkSession
    count = lambda df: {r.p: r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = count(docs)
    if len(sizes) > max_sources:
        docs = docs.coalesce(max_sources)
        sizes = count(docs)
    total = sum(sizes.values())
    shards = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([sizes[p] for p in sorted(sizes)], shards, seed)
    ends = [(p, np.cumsum(m).tolist()) for p, m in zip(sorted(sizes), matrix, strict=True)]
    plan = spark.createDataFrame(ends, "__p long, __ends array<long>")
    cells = min(max_cells, max(1, -(-total // (n_shards * cell_rows))))

    # The cell of a place doesn't depend on the row that comes to lie there: this pass reads no column.
    taken = _placed(docs.select(), plan, seed, cells).groupBy("__shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = taken.select("__shard", "__cell", "__n", before.alias("__start"))

    # By the row's place, not by what it holds: equal rows go apart like any others.
    permuted = docs.withColumn("__at", F.monotonically_increasing_id()).sortWithinPartitions(F.xxhash64(F.lit(seed), "__at"), "__at")
    rows = _placed(permuted, plan, seed, cells)
    inside = F.row_number().over(Window.partitionBy("__shard", "__cell").orderBy("__order", "__p", "__r"))
    there = F.count(F.lit(1)).over(Window.partitionBy("__shard", "__cell"))
    rows = rows.withColumns({"__inside": inside, "__there": there}).join(F.broadcast(starts), ["__shard", "__cell"])
    fewer = F.raise_error(F.lit("the input listed fewer rows when read again; pass stable=False")).cast("int")
    rows = rows.withColumn("__inside", F.when(F.col("__there") == F.col("__n"), F.col("__inside")).otherwise(fewer))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), F.col("__shard").alias("shard"), (F.col("__start") + F.col("__inside") - 1).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, each file in slot order."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(sharded: DataFrame) -> DataFrame:
    """What the query returns of the rows; a null text has no bytes."""
    data: Column = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return sharded.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_digest(shard_rows(docs, 8, stable=True))
