"""Scores of all pairs in tiles.

Vectors are dealt into parts of about ``rows`` each, and every two parts meet in one task, which scores its tile of
pairs, a square of 1,024 by 1,024 after the other, by matrix products and sparse sums. Each part is packed into one row, and a Cartesian product of those rows reads a part
again for each other one, so that nothing is written more than once, however many parts there are. A pair never moves, and no key gathers
the vectors that share it, so a common term is no hot key. Within blocks only the parts of a block meet, and vectors move once for each part of theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import Stages

#: Vectors of a part at most, and of a square that a task scores at once; smaller tables are dealt into up to LEAST_PARTS parts, so that their tiles keep all cores busy.
PART_ROWS, ROWS, LEAST_PARTS = 4_096, 1_024, 8


class _Side:
    """The vectors of one part: ids, and their entries as (row, key, value)."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        column = lambda c: pa.concat_arrays(t.column(c).chunks) if t.num_rows else pa.array([], t.schema.field(c).type)
        self.ids, vals = column("id"), column("vals")
        self.n = len(self.ids)
        self.lengths = pc.fill_null(pc.list_value_length(vals), 0).to_numpy(zero_copy_only=False)
        self.rows, self.vals = np.repeat(np.arange(self.n), self.lengths), vals.flatten().to_numpy(zero_copy_only=False)
        self.keys = column("keys").flatten().to_numpy(zero_copy_only=False) if "keys" in t.schema.names else None
        self.norms = np.sqrt(np.bincount(self.rows, self.vals * self.vals, self.n))

    def of(self, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries (number of the key, row, value) of the common keys, by key."""
        at = np.minimum(np.searchsorted(common, self.keys), max(0, len(common) - 1))
        held = np.flatnonzero(common[at] == self.keys) if len(common) else np.zeros(0, np.int64)
        held = held[np.argsort(at[held], kind="stable")]
        return at[held], self.rows[held], self.vals[held]


def _common(a: _Side, b: _Side) -> np.ndarray:
    return np.intersect1d(np.unique(a.keys), np.unique(b.keys), assume_unique=True)


def products(a: _Side, b: _Side, width: int = 1_024, most: int = 4_000_000) -> np.ndarray:
    """Inner products of all vectors of a and b: keys that many hold by matrix products, the others pair by pair."""
    out, common = np.zeros((a.n, b.n)), _common(a, b)
    (ca, ra, va), (cb, rb, vb) = a.of(common), b.of(common)
    in_a, in_b = np.bincount(ca, minlength=len(common)), np.bincount(cb, minlength=len(common))
    dense = in_a * in_b * 64 >= out.size
    at = np.cumsum(dense) - 1
    for lo in range(0, int(dense.sum()), width):
        sides = []
        for c, r, v, n in ((ca, ra, va, a.n), (cb, rb, vb, b.n)):
            mine = dense[c] & (at[c] >= lo) & (at[c] < lo + width)
            m = np.zeros((n, width))
            m[r[mine], at[c[mine]] - lo] = v[mine]
            sides.append(m)
        out += sides[0] @ sides[1].T
    few = ~dense[ca]
    ca, ra, va = ca[few], ra[few], va[few]
    start, times = np.concatenate([[0], np.cumsum(in_b)]), in_b[ca]
    ends, i = np.cumsum(times), 0
    while i < len(ca):
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
        reps = times[i:j]
        inside = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        k = np.repeat(start[ca[i:j]], reps) + inside
        out += np.bincount(np.repeat(ra[i:j], reps) * b.n + rb[k], np.repeat(va[i:j], reps) * vb[k], out.size).reshape(out.shape)
        i = j
    return out


def divergences(a: _Side, b: _Side) -> np.ndarray:
    """Jensen-Shannon divergences: ln 2 and half a sum over the common keys."""
    out, common = np.zeros((a.n, b.n)), _common(a, b)
    (ca, ra, va), (cb, rb, vb) = a.of(common), b.of(common)
    for k in range(len(common)):
        i, j = slice(*np.searchsorted(ca, [k, k + 1])), slice(*np.searchsorted(cb, [k, k + 1]))
        p, q = va[i][:, None], vb[j][None, :]
        m = (p + q) / 2
        out[np.ix_(ra[i], rb[j])] += p * np.log(p / m) + q * np.log(q / m) - (p + q) * np.log(2.0)
    return np.log(2.0) + out / 2


def _scores(kind: str, a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray]:
    """The scores, and which pairs have something in common."""
    if kind == "divergence":
        s = divergences(a, b)
        return s, np.ones(s.shape, bool)
    if kind == "dense":
        dot = a.vals.reshape(a.n, -1) @ b.vals.reshape(b.n, -1).T if a.n and b.n else np.zeros((a.n, b.n))
    else:
        dot = products(a, b)
    below = a.lengths[:, None] + b.lengths[None, :] - dot if kind == "jaccard" else a.norms[:, None] * b.norms[None, :]
    return np.divide(dot, below, out=np.full(dot.shape, np.nan), where=below > 0), dot != 0


def parts_of(n: Column, rows: int) -> Column:
    return F.greatest(F.ceil(n / F.lit(rows)), F.least(F.ceil(n / F.lit(ROWS)), F.lit(LEAST_PARTS))).cast("int")


def _squares(t: pa.Table) -> Iterator[tuple[list[pa.Table], list[pa.Table], int, int]]:
    """The two parts of a tile in slices of ROWS, and the numbers of each two slices that meet: those of one part with itself once."""
    part, i, j = t.column("part").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
    cut = lambda x: [x.slice(k, ROWS).combine_chunks() for k in range(0, x.num_rows, ROWS)]
    a = cut(t.filter(pa.array(part == i)))
    b = a if i == j else cut(t.filter(pa.array(part == j)))
    for x in range(len(a)):
        for y in range(x if i == j else 0, len(b)):
            yield a, b, x, y


def _ordered(a_ids: pa.Array, b_ids: pa.Array, same: bool, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """The rows of the pairs, and their ids, the smaller first; of one slice with itself each pair once."""
    ranks = pc.rank(pa.concat_arrays([a_ids, b_ids]), tiebreaker="dense").to_numpy()
    before = ranks[: len(a_ids), None] < ranks[None, len(a_ids) :]
    chosen = before if same else np.ones(before.shape, bool)
    x, y = np.nonzero(chosen if wanted is None else chosen & wanted)
    swap = pa.array(~before[x, y])
    of_a, of_b = a_ids.take(pa.array(x)), b_ids.take(pa.array(y))
    return x, y, pc.if_else(swap, of_b, of_a), pc.if_else(swap, of_a, of_b)


def crossed(dealt: DataFrame, parts: int, tile: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, cells: bool = False) -> DataFrame:
    """What ``tile`` gives for every two of the parts of dealt (part, …), each of them with itself too; its batches hold both parts, told by i, j and part.

    With ``cells`` a column cell is the same all over a part, and only parts of the same or of the next cell meet. A part is a row of its packed
    vectors, so it should hold some ten megabytes; the rows are shuffled once, into ``parts`` partitions, every two of which are a task that reads them again.
    """

    def pack(t: pa.Table) -> pa.Table:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, t.schema) as w:
            w.write_table(t)
        return pa.table({"part": t.column("part").slice(0, 1), "cell": t.column("cell").slice(0, 1) if cells else pa.array([0], pa.int32()), "packed": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    rows = dealt.groupBy("part").applyInArrow(pack, "part int, cell int, packed binary")
    rows = rows.repartition(parts, "part")
    of = lambda p, s: rows.select(F.col("part").alias(p), F.col("cell").alias(f"cell_{p}"), F.col("packed").alias(s))
    meet = (F.col("i") <= F.col("j")) & (F.abs(F.col("cell_i") - F.col("cell_j")) <= 1)
    both = of("i", "a").join(of("j", "b").hint("shuffle_replicate_nl"), meet).select("i", "j", "a", "b")

    def met_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                i, j, a, b = (batch.column(c)[k].as_py() for c in ("i", "j", "a", "b"))
                t = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in ([a] if i == j else [a, b])])
                for name, v in (("i", i), ("j", j)):
                    t = t.append_column(name, pa.array(np.full(t.num_rows, v, np.int32)))
                yield from tile(iter(t.combine_chunks().to_batches()))

    return both.mapInArrow(met_parts, schema)


def in_parts(vectors: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The vectors, written, with their part, and the number of parts."""
    vectors = Stages(vectors.sparkSession, "tiles").written(vectors, "vectors")
    parts = vectors.agg(F.coalesce(parts_of(F.count(F.lit(1)), rows), F.lit(0)).alias("n")).first().n or 1
    return vectors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), parts


def tiled(vectors: DataFrame, kind: str, least: float | None = None, every: bool = True, block: str | None = None, rows: int = PART_ROWS) -> DataFrame:
    """(id_a, id_b, score) of all pairs of vectors (id, keys, vals), id_a < id_b; of those of a block if a column is named.

    kind: cosine, jaccard (vals are 1), divergence, or dense (no keys, vals of one length). Without ``every`` only
    pairs with something in common, with ``least`` only those with that score. A score is null where it is 0/0. keys are
    compared as numbers. An empty table gives no pair; ids are unique and not null.
    """
    if block is None:
        dealt, parts = in_parts(vectors.select(*(c for c in ("id", "keys", "vals") if c in vectors.columns)), rows)
        return crossed(dealt, parts, *_tile(kind, least, every, dealt.schema["id"].dataType.simpleString()))
    base = vectors.withColumn("block", F.col(block))
    sizes = base.groupBy("block").agg(parts_of(F.count(F.lit(1)), rows).alias("parts"))
    base = base.join(sizes, base["block"].eqNullSafe(sizes["block"])).drop(sizes["block"])
    base = base.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kept = [c for c in ("id", "keys", "vals") if c in vectors.columns]
    return met(base.select("block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", *kept), kind, least, every)


def met(dealt: DataFrame, kind: str, least: float | None = None, every: bool = True) -> DataFrame:
    """(id_a, id_b, score) of the pairs of each tile: vectors (block, i, j, part, id, keys, vals), where part is i or j."""
    return dealt.groupBy("block", "i", "j").applyInArrow(*_tile(kind, least, every, dealt.schema["id"].dataType.simpleString()))


def _tile(kind: str, least: float | None, every: bool, kind_of_id: str) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    """What scores a tile, and the schema of its rows (id_a, id_b, score)."""

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[tuple[bool, int], _Side] = {}
        for of_a, of_b, i, j in _squares(pa.Table.from_batches(batches)):
            for own, k in ((of_a, i), (of_b, j)):
                if (own is of_a, k) not in sides:
                    sides[own is of_a, k] = _Side(own[k])
            a, b = sides[True, i], sides[of_b is of_a, j]
            score, shared = _scores(kind, a, b)
            wanted = np.ones(score.shape, bool) if every else shared
            x, y, first, second = _ordered(a.ids, b.ids, a is b, wanted if least is None else wanted & (score >= least))
            s = score[x, y]
            yield pa.RecordBatch.from_arrays([first, second, pa.array(s, mask=np.isnan(s))], ["id_a", "id_b", "score"])

    return tile, f"id_a {kind_of_id}, id_b {kind_of_id}, score double"


def _coded(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Equal values as equal numbers, null as -1."""
    codes = pc.fill_null(pa.concat_arrays([a, b]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return codes[: len(a)], codes[len(a) :]


def with_features(items: DataFrame, same: Sequence[str], mean: str, every: bool, rows: int = PART_ROWS) -> DataFrame:
    """(id_a, id_b, cosine, jaccard, same_c, mean) of all pairs of items (id, keys, vals, words, columns of ``same``, ``mean``), of those with a common key only unless ``every``.

    Both scores, flags and means are made where a pair is made, so no pair is joined to anything. words are hashes. A score is null where it is 0/0,
    same_c where either is null; the mean is of those that are not null; ids are unique and not null.
    """
    dealt, parts = in_parts(items, rows)

    def side(t: pa.Table) -> tuple[pa.Table, _Side, _Side]:
        words = pa.concat_arrays(t.column("words").chunks)
        ones = pa.ListArray.from_arrays(words.offsets, pa.array(np.ones(len(words.values))))
        return t, _Side(t), _Side(pa.table({"id": t.column("id"), "keys": words, "vals": ones}))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[tuple[bool, int], tuple] = {}
        for of_a, of_b, i, j in _squares(pa.Table.from_batches(batches)):
            for own, k in ((of_a, i), (of_b, j)):
                if (own is of_a, k) not in sides:
                    sides[own is of_a, k] = side(own[k])
            (ta, a, wa), (tb, b, wb) = sides[True, i], sides[of_b is of_a, j]
            cosine, shared = _scores("cosine", a, b)
            x, y, first, second = _ordered(a.ids, b.ids, a is b, None if every else shared)
            jaccard, _ = _scores("jaccard", wa, wb)
            out = [first, second, *(pa.array(s[x, y], mask=np.isnan(s[x, y])) for s in (cosine, jaccard))]
            for c in same:
                p, q = _coded(*(pa.concat_arrays(t.column(c).chunks) for t in (ta, tb)))
                out.append(pa.array((p[x] == q[y]).astype(np.int32), mask=(p[x] < 0) | (q[y] < 0)))
            p, q = (t.column(mean).to_numpy().astype(float) for t in (ta, tb))
            p, q = p[x], q[y]
            m = np.where(np.isnan(p), q, np.where(np.isnan(q), p, (p + q) / 2))
            yield pa.RecordBatch.from_arrays([*out, pa.array(m, mask=np.isnan(m))], names)

    names = ["id_a", "id_b", "cosine", "jaccard", *(f"same_{c}" for c in same), "mean"]
    kind_of_id = items.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id_a {kind_of_id}", f"id_b {kind_of_id}", "cosine double", "jaccard double", *(f"`same_{c}` int" for c in same), "mean double"])
    return crossed(dealt, parts, tile, schema)


def sparse(rows: DataFrame, id_col: str, key: Column, value: Column) -> DataFrame:
    """(id, keys, vals) from a row for each entry; keys are hashed to 64 bits."""
    entries = rows.select(F.col(id_col).alias("id"), F.struct(F.xxhash64(key).alias("k"), value.cast("double").alias("v")).alias("e"))
    lists = entries.groupBy("id").agg(F.collect_list("e").alias("e"))
    return lists.select("id", F.col("e.k").alias("keys"), F.col("e.v").alias("vals"))
