"""What the findings of round 4 named: vectors that were shuffled once for each part of the table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import threshold, tiles


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["dense", "cosine"])
def test_vectors_of_tiles_are_not_copied_for_each_part(spark, kind):
    """Each vector was exploded to as many rows as there are parts, and shuffled."""
    draw = np.random.default_rng(4)
    rows = [(i, [1, 2, 3 + i % 5], draw.normal(size=3).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, keys array<long>, vals array<double>")
    out = tiles.tiled(df.drop("keys") if kind == "dense" else df, kind, rows=9)
    assert "CartesianProduct" in plan(out) and "Generate" not in plan(out)
    got = {(r.id_a, r.id_b) for r in out.collect()}
    assert got == {(a, b) for a in range(40) for b in range(a + 1, 40)}


def test_vectors_over_a_threshold_are_not_copied_for_each_part(spark, monkeypatch):
    """as above, in the parts of a join over a threshold."""
    plans, crossed = [], tiles.crossed
    monkeypatch.setattr(tiles, "crossed", lambda *a, **k: plans.append(plan(out := crossed(*a, **k))) or out)
    sets = [(i, [f"w{j}" for j in range(i % 7, i % 7 + 1 + i // 3)]) for i in range(60)]
    df = spark.createDataFrame(sets, "id long, words array<string>")
    got = {(r.id_a, r.id_b): r.jaccard for r in threshold.jaccard_over(df, 0.7, tile_entries=90).collect()}
    of = dict((i, set(w)) for i, w in sets)
    every = {(a, b): len(of[a] & of[b]) / len(of[a] | of[b]) for a in of for b in of if a < b}
    assert got == pytest.approx({k: x for k, x in every.items() if x >= 0.7})
    counts = df.select(F.col("id").alias("doc"), F.explode("words").alias("term"), F.lit(1).alias("n"))
    r = threshold.skipped(counts, 0.9, tile_entries=90).first()
    assert r.candidates <= r.pairs and r.tiles_met <= r.tiles
    assert len(plans) == 2 and all("CartesianProduct" in p and "Generate" not in p for p in plans)
