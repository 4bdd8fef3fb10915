"""Forests on histograms against plain arithmetic on the rows they draw."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilth import catalog
from tilth.operators import forest, stats, trees
from tilth.operators.gram import FeatureSpec
from tilth.plans import experiments
from tilth.sources import models

SPEC = FeatureSpec(("x", "z"), ("wet",), ("crop",), "y")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for i in range(600):
        x, z, wet, crop = int(rng.integers(0, 20)), int(rng.integers(0, 9)), bool(rng.integers(0, 2)), "abc"[rng.integers(0, 3)]
        out.append((i, float(x), float(z), wet, crop, float(3 * (x > 7) + (crop == "b") * 2 + wet + rng.normal() / 4), i % 3))
    return out


@pytest.fixture(scope="module")
def data(spark, rows):
    return spark.createDataFrame(rows, "id int, x double, z double, wet boolean, crop string, y double, fold int").coalesce(1).cache()


def grown(x, y, w, tests, depth):
    """Predictions of the best-split tree on weighted rows, by trying every split."""
    out = np.full(len(y), np.average(y, weights=w) if w.sum() else 0.0)
    if depth == 0 or w.sum() < 2:
        return out
    best = (1e-9, None)
    for low in tests(x):
        a, b = w[low].sum(), w[~low].sum()
        if a and b:
            gain = (w[low] @ y[low]) ** 2 / a + (w[~low] @ y[~low]) ** 2 / b - (w @ y) ** 2 / w.sum()
            best = max(best, (gain, low), key=lambda g: g[0])
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = grown([c[side] for c in x], y[side], w[side], tests, depth - 1)
    return out


@pytest.mark.parametrize("depth", [1, 4])
def test_a_forest_is_the_mean_of_best_split_trees_on_drawn_rows(spark, data, rows, depth):
    found = trees.random_forest(data, SPEC, trees=3, depth=depth, seed=7)
    assert isinstance(found, forest.Forest) and len(found.trees) == 3
    x, z, wet, crop, y = (np.array([r[i] for r in rows]) for i in range(1, 6))
    known = [np.unique(v) for v in (x, z)]

    def tests(c):
        for i, values in enumerate(known):
            yield from (c[i] <= v for v in values[:-1])
        yield ~c[2]
        yield from (c[3] == k for k in "abc")

    want = np.mean([grown([x, z, wet, crop], y, forest._drawn(7, t, 0, len(y)).astype(float), tests, depth) for t in range(3)], axis=0)
    got = {r.id: r.prediction for r in found.transform(data).select("id", "prediction").collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(want.tolist(), abs=1e-7)


def test_rows_are_drawn_as_a_bootstrap_draws_them():
    times = np.concatenate([forest._drawn(1, t, b, 100_000) for t in range(3) for b in range(3)])
    shares = np.bincount(times, minlength=9) / len(times)
    assert shares[:4] == pytest.approx([0.36788, 0.36788, 0.18394, 0.06131], abs=0.002) and times.mean() == pytest.approx(1, abs=0.005)
    assert not np.array_equal(forest._drawn(1, 0, 0, 1000), forest._drawn(1, 0, 1, 1000))


def test_blocks_and_waves_change_no_sums(spark, data, monkeypatch):
    whole = trees.random_forest(data, SPEC, trees=4, depth=5)
    monkeypatch.setattr(forest, "WAVE", 3)
    monkeypatch.setattr(forest, "HELD", 1)
    monkeypatch.setattr(forest, "RANGE", 2)
    assert [t for t in trees.random_forest(data, SPEC, trees=4, depth=5).trees] == whole.trees


def test_errors_of_folds_are_those_of_scored_rows(spark, data, monkeypatch):
    monkeypatch.setattr(forest, "WAVE", 2)
    monkeypatch.setattr(forest, "CUT", 2)
    run = experiments.cross_validate(data, SPEC, "random_forest", folds=3, trees=5, depth=4)
    for r in run.metrics.collect():
        scored = run.models[r.fold].transform(data).withColumn("held", F.col("fold") == r.fold)
        for m in stats.regression_metrics(scored, "y", "prediction", ["held"]).collect():
            side = "val" if m.held else "train"
            for name in ("rows", "r2", "mae", "rmse"):
                assert r[f"{side}_{name}"] == pytest.approx(m[name], abs=1e-9)


def test_a_forest_is_saved_with_its_kind(spark, data, tmp_path):
    model = trees.random_forest(data, SPEC, trees=3, depth=3)
    models.save_bundle(spark, model, str(tmp_path / "f"), note="n")
    again, about = models.load_bundle(spark, str(tmp_path / "f"))
    assert isinstance(again, forest.Forest) and about == {"note": "n"}
    both = [m.transform(data).agg(F.sum("prediction")).first()[0] for m in (model, again)]
    assert both[0] == pytest.approx(both[1], abs=1e-9)
    assert sum(again.importances().values()) == pytest.approx(1.0)


def test_odd_tables_have_forests(spark, data):
    empty = trees.random_forest(data.limit(0), SPEC, trees=2, depth=2)
    assert empty.transform(data.limit(3)).where("prediction <> 0").isEmpty()
    same = trees.random_forest(data.withColumn("y", F.lit(2.5)), SPEC, trees=2, depth=3)
    assert same.transform(data).where("prediction <> 2.5").isEmpty()
    holes = data.withColumn("x", F.when(F.col("id") % 2 == 0, F.col("x"))).withColumn("crop", F.when(F.col("id") % 3 > 0, F.col("crop")))
    assert holes.join(trees.random_forest(holes, SPEC, trees=2, depth=3).transform(holes).where("prediction is null"), "id").isEmpty()


def test_forest_queries_need_no_assembled_vectors(spark, sf_dir, monkeypatch):
    real = trees.random_forest
    monkeypatch.setattr(trees, "random_forest", lambda df, spec, **kw: real(df, spec, trees=3, depth=3, **kw))
    monkeypatch.setattr(trees, "_fit", None)
    assert {r.split for r in catalog.QUERIES["random_forest"](spark, sf_dir).collect()} == {"train", "test"}
    assert sum(r.importance for r in catalog.QUERIES["tree_importances"](spark, sf_dir).collect()) == pytest.approx(1.0)
