"""What the findings of round 3 named: steps whose disk or time grew faster than their input, second part."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from lexigrid.operators import ordered, report, threshold, tiles
from lexigrid.plans import pair_queries
from lexigrid.sources.stage import Stages


SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pair_is_shuffled_to_meet_on_a_term(spark, monkeypatch):
    """Vectors were joined on the terms of their prefixes, a row for each pair and term."""
    plans, written = [], Stages.written
    monkeypatch.setattr(Stages, "written", lambda self, df, name: plans.append(plan(df)) or written(self, df, name))
    rows = [(i, w, 1 + i % 3) for i in range(60) for w in ("common", f"w{i % 20}", f"v{i % 7}")]
    dtm = spark.createDataFrame(rows, "doc long, term string, n long")
    assert threshold.cosine_over(dtm, 0.6).count() > 60
    threshold.skipped(dtm, 0.6).collect()
    threshold.jaccard_over(dtm.groupBy("doc").agg({"term": "collect_list"}).toDF("id", "words"), 0.5).count()
    assert len(plans) >= 9 and not any("Join [term" in p for p in plans)


def test_quartiles_of_a_table_write_none_of_its_rows(spark, monkeypatch):
    """the rows, their values and the ranges of the values were written one after another."""
    named, written = [], Stages.written
    monkeypatch.setattr(Stages, "written", lambda self, df, name: named.append(name) or written(self, df, name))
    rng = np.random.default_rng(8)
    x, g = np.round(np.exp(rng.normal(size=20_000) * 3), 3), rng.integers(0, 2, 20_000)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x, strict=True)], "g int, x double")
    for most in (100_000, 5_000):
        named.clear()
        got = {r.g: [r.x_0, r.x_1, r.x_2] for r in ordered.quantiles(df, "g", ("x",), most=most).collect()}
        assert got == {i: pytest.approx(np.quantile(x[g == i], [0.25, 0.5, 0.75]).tolist()) for i in (0, 1)}
        assert most == 5_000 or set(named) <= {"sizes", "near"}
    named.clear()
    assert {r.g: r.x_count for r in report.describe(df, "g", ("x",), stored=True).collect()} == {i: int((g == i).sum()) for i in (0, 1)}
    assert set(named) <= {"sizes", "near"}


@pytest.mark.parametrize("name", ["pair_features", "scored_pairs"])
def test_features_of_pairs_get_no_join(spark, name):
    """scores, labels and attributes were joined to all pairs."""
    f = pair_queries.document_features(spark, SF) if name == "pair_features" else pair_queries.whole_features(spark, SF)
    text = plan(f)
    assert "id_a" in text and not any("Join" in line and "id_a" in line for line in text.splitlines())
    assert not any("Exchange" in line and "id_a" in line for line in text.splitlines())


def test_parts_are_larger_than_squares(spark):
    """a vector moved once for each 1,024 of the others."""
    rng = np.random.default_rng(9)
    m = rng.normal(size=(2_500, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vals array<double>")
    assert spark.range(1).select(tiles.parts_of(F.lit(1_000_000), tiles.PART_ROWS)).first()[0] == 245
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    c = (unit @ unit.T)[np.triu_indices(2_500, 1)]
    out = tiles.tiled(df, "dense", rows=1_300).agg(F.count("*"), F.sum("score"), F.count_if(F.expr("id_a < id_b"))).first()
    assert (out[0], out[2]) == (len(c), len(c)) and out[1] == pytest.approx(c.sum())
