"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of documents by a hash, which also is their random order. From a source's
target follows how many whole passes over its blocks the mix makes, and how far the last, partial pass goes;
the block in which it ends is cut between two documents. The blocks so drawn are the source's quota. A
binary tree over the output shards splits the quotas: at each node a multivariate hypergeometric draw decides
how many blocks of each source go left, so that every shard gets its exact number of blocks. The draws of a
source are disjoint runs of its permuted blocks; inside a shard the documents are ordered by a hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words_of, shielded, table, written
from .sharding import hypergeometric

WEIGHTS = (3.0, 1.0, 2.0)


def targets_of(sizes: list[int], weights: list[float], factor: float = 1.5, limit: float = 2.0) -> list[float]:
    """factor times all sizes, shared by weight; what is over limit times a source's size goes to the others, until none is above."""
    left, free, target = factor * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        whole = sum(weights[i] for i in free)
        share = {i: left * weights[i] / whole for i in free}
        over = [i for i in sorted(free) if share[i] > limit * sizes[i]]
        if not over:
            for i, x in share.items():
                target[i] = x
            break
        for i in over:
            target[i] = limit * sizes[i]
            left -= target[i]
            free.discard(i)
    return target


def split_tree(quotas: list[int], n_shards: int, rng: np.random.Generator) -> list[list[int]]:
    """Blocks of each source for each shard; shards differ by one block at most."""
    total = sum(quotas)
    room = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    out: list[list[int]] = [[] for _ in room]

    def descend(lo: int, hi: int, have: list[int]) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        left, rest, go = sum(room[lo:mid]), sum(have), []
        for h in have:
            rest -= h
            k = hypergeometric(rng, h, rest, left) if left and h else 0
            go.append(k)
            left -= k
        descend(lo, mid, go)
        descend(mid, hi, [h - k for h, k in zip(have, go, strict=True)])

    descend(0, n_shards, quotas)
    return out


@shielded
def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, factor: float = 1.5, limit: float = 2.0, n_shards: int = 16, seed: int = 0, source_col: str = "source", text_col: str = "text", block_rows: int = 64, max_blocks: int = 200_000, tries: int = 16) -> DataFrame:
    """All rows of docs with size, source_size, target, draws and taken.

    Weights repeat over the sources in code-point order, a null source last. draws: one (shard, place) for
    each time the mix takes the document, at most twice for limit 2; place orders a shard at random. taken is
    size times the number of draws. A document without words is taken with its block and adds nothing.
    Repeated rows are drawn together; columns of these names are replaced; an empty table gives an empty one.
    The blocks, max_blocks at most over all sources (and one a source), are planned on the driver: some 500
    bytes for each, so that a million sources are its limit.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "source_size", "target", "draws", "taken")
    key = lambda k: F.xxhash64(F.lit(seed + k), *(F.col(f"`{c}`") for c in sorted({"doc_id", text_col} & set(docs.columns))))
    rows = docs.select("*", n_words_of(F.col(text_col)).alias("size"), key(0).alias("__h"))
    narrow = written(rows.select(F.col(source_col).alias("source"), "size", "__h"), "mix-sizes")

    found = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    found = sorted(found, key=lambda r: (r.source is None, str(r.source or "")))
    all_rows = sum(r.n for r in found)
    sizes = [int(r["size"]) for r in found]
    target = targets_of(sizes, [weights[i % len(weights)] for i in range(len(found))], factor, limit)
    blocks = [max(1, min(-(-r.n // block_rows), max_blocks * r.n // max(1, all_rows))) for r in found]
    known = spark.createDataFrame([(r.source, i, b, s, t) for i, (r, b, s, t) in enumerate(zip(found, blocks, sizes, target, strict=True))], f"__source {narrow.schema['source'].dataType.simpleString()}, __s int, __blocks int, source_size long, target double")

    def numbered(df: DataFrame, source: Column) -> DataFrame:
        df = df.join(F.broadcast(known), source.eqNullSafe(F.col("__source")), "left").drop("__source")
        return df.withColumn("__block", F.pmod("__h", F.col("__blocks")).cast("int"))

    words = numbered(narrow, F.col("source")).groupBy("__s", "__block").agg(F.sum("size").alias("w")).collect()
    by_source: dict[int, dict[int, int]] = {i: {} for i in range(len(found))}
    for r in words:
        by_source[r["__s"]][r["__block"]] = int(r.w)
    rng = np.random.default_rng(seed)
    drawn: list[list[tuple[int, bool]]] = []  # of each source its blocks in the order of the draws, and whether to the cut only
    ends: list[tuple[int, int, float]] = []
    for i, t in enumerate(target):
        own = sorted(by_source[i])
        passes = min(int(limit), math.floor(t / sizes[i])) if sizes[i] else 0
        order = [own[k] for k in rng.permutation(len(own))]
        draws = [(b, False) for _ in range(passes) for b in order]
        need = t - passes * sizes[i]
        for b in order if passes < limit else []:
            if need <= 0:
                break
            if by_source[i][b] > need:
                draws.append((b, True))
                ends.append((i, b, float(need)))
                break
            draws.append((b, False))
            need -= by_source[i][b]
        drawn.append(draws)

    # Of the last block of a source, in a random order, go the documents up to where no more fits, and one
    # of those behind if its size comes nearer to what is then lacking than taking none does. Of ``tries``
    # orders the one that ends nearest is kept.
    cuts: dict[int, list[int]] = {}
    if ends:
        last = spark.createDataFrame(ends, "__s int, __block int, __need double")
        inside = numbered(narrow, F.col("source")).join(F.broadcast(last), ["__s", "__block"]).withColumn("__try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
        inside = inside.groupBy("__s", "__try", "__need", F.xxhash64("__h", "__try").alias("__cut")).agg(F.sum("size").alias("w"))
        inside = inside.withColumn("__run", F.sum("w").over(Window.partitionBy("__s", "__try").orderBy("__cut")))
        fits, least = F.col("__run") <= F.col("__need"), F.lit(-(2**63)).cast("long")
        whole = inside.groupBy("__s", "__try").agg(F.max(F.when(fits, F.col("__cut"))).alias("__until"), (F.first("__need") - F.coalesce(F.max(F.when(fits, F.col("__run"))), F.lit(0))).alias("__lack"))
        rest = inside.filter(~fits).join(whole, ["__s", "__try"]).withColumn("__off", F.abs(F.col("w") - F.col("__lack"))).filter(F.col("__off") < F.col("__lack"))
        extra = rest.groupBy("__s", "__try").agg(F.min(F.struct("__off", "__cut")).alias("b"))
        ended = whole.join(extra, ["__s", "__try"], "left").withColumn("__off", F.coalesce("b.__off", "__lack"))
        best = ended.groupBy("__s").agg(F.min(F.struct("__off", "__try", F.coalesce("__until", least).alias("until"), F.coalesce("b.__cut", least).alias("extra"))).alias("x"))
        cuts = {r["__s"]: [r.x["__try"], r.x["until"], r.x["extra"]] for r in best.collect()}

    split = split_tree([len(d) for d in drawn], n_shards, rng)
    plan: dict[tuple[int, int], list[tuple[int, list[int] | None]]] = {}
    for i, draws in enumerate(drawn):
        order = rng.permutation(len(draws))
        shards = np.repeat(np.arange(n_shards), [split[j][i] for j in range(n_shards)])
        for j, k in zip(shards, order, strict=True):
            b, part = draws[k]
            if not part or i in cuts:
                plan.setdefault((i, b), []).append((int(j), cuts[i] if part else None))
    planned = spark.createDataFrame([(i, b, sorted(x, key=lambda y: (y[1] is not None, y[0]))) for (i, b), x in sorted(plan.items())], "__s int, __block int, __draws array<struct<shard: int, until: array<bigint>>>")

    out = numbered(rows, F.col(source_col)).join(F.broadcast(planned), ["__s", "__block"], "left")
    mine = F.filter(F.coalesce("__draws", F.array().cast("array<struct<shard: int, until: array<bigint>>>")), lambda d: d["until"].isNull() | (F.xxhash64("__h", d["until"][0].cast("int")) <= d["until"][1]) | (F.xxhash64("__h", d["until"][0].cast("int")) == d["until"][2]))
    draws = F.transform(mine, lambda d, k: F.struct(d["shard"].alias("shard"), F.xxhash64(F.lit(seed + 2), "__h", k).alias("place")))
    out = out.withColumn("draws", draws).withColumn("taken", F.col("size") * F.size("draws"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), "size", "source_size", "target", "draws", "taken")


def mixed_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each draw, with its shard and place."""
    return mixed.select(*(F.col(f"`{c}`") for c in columns), F.explode("draws").alias("__d")).select(*(F.col(f"`{c}`") for c in columns), "__d.shard", "__d.place")


def write_mix(mixed: DataFrame, columns: list[str], path: str) -> None:
    """One folder a shard, its rows in the order of their places."""
    mixed_rows(mixed, columns).repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",")  # where the tree sends each draw
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))
