"""Forests without a limit of depth, grown to the end in tasks and scored there; what passes carry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_forest import SPEC, data, grown, rows  # noqa: F401
from tilth import catalog
from tilth.operators import boosting, forest, stats, trees
from tilth.plans import experiments
from tilth.sources import models


def predicted(model, data):
    return {r.id: r.prediction for r in model.transform(data).select("id", "prediction").collect()}


def test_trees_are_grown_to_the_end_without_a_depth(spark, data, rows):  # noqa: F811
    found = trees.random_forest(data, SPEC, trees=1, seed=7)
    x, z, wet, crop, y = (np.array([r[i] for r in rows]) for i in range(1, 6))
    known = [np.unique(v) for v in (x, z)]

    def tests(c):
        for i, values in enumerate(known):
            yield from (c[i] <= v for v in values[:-1])
        yield ~c[2]
        yield from (c[3] == k for k in "abc")

    drawn = forest._drawn(7, 0, 0, len(y)).astype(float)
    want, got = grown([x, z, wet, crop], y, drawn, tests, 10_000), predicted(found, data)
    # rows of equal codes share a leaf, all others have their own
    for i in np.flatnonzero(drawn):
        assert got[i] == pytest.approx(want[i], abs=1e-7)
        same = (x == x[i]) & (z == z[i]) & (wet == wet[i]) & (crop == crop[i])
        assert got[i] == pytest.approx(np.average(y[same], weights=drawn[same]), abs=1e-7)


def test_passes_and_tasks_grow_the_same_trees(spark, data, tmp_path, monkeypatch):  # noqa: F811
    whole = trees.random_forest(data, SPEC, trees=5)
    want = predicted(whole, data)
    deep = predicted(trees.random_forest(data, SPEC, trees=5, depth=30), data)  # all levels by passes
    assert [deep[i] for i in want] == pytest.approx([want[i] for i in want], abs=1e-9)
    for name, value in (("SMALL", 40), ("SHARE", 1 << 30), ("PART", 60), ("ASIDE", 25), ("SPARSE", 0), ("MOVED", 600 * 20 * 2), ("CUT", 2)):
        monkeypatch.setattr(forest, name, value)
    cut = trees.random_forest(data, SPEC, trees=5)
    got = predicted(cut, data)
    assert cut.below.count() > 10 and [got[i] for i in want] == pytest.approx([want[i] for i in want], abs=1e-9)
    assert cut.importances() == pytest.approx(whole.importances(), abs=1e-9)
    models.save_bundle(spark, cut, str(tmp_path / "f"))
    again, _ = models.load_bundle(spark, str(tmp_path / "f"))
    assert predicted(again, data) == pytest.approx(got, abs=1e-9)


def test_errors_of_folds_with_trees_grown_to_the_end(spark, data, monkeypatch):  # noqa: F811
    monkeypatch.setattr(forest, "SMALL", 50)
    monkeypatch.setattr(forest, "SHARE", 1 << 30)
    run = experiments.cross_validate(data, SPEC, "random_forest", folds=3, trees=3)
    for r in run.metrics.collect():
        scored = run.models[r.fold].transform(data).withColumn("held", F.col("fold") == r.fold)
        for m in stats.regression_metrics(scored, "y", "prediction", ["held"]).collect():
            side = "val" if m.held else "train"
            for name in ("rows", "r2", "mae", "rmse"):
                assert r[f"{side}_{name}"] == pytest.approx(m[name], abs=1e-9)


def test_the_forest_queries_set_no_depth(spark, sf_dir, monkeypatch):
    real, given = forest.train, []

    def fewer(df, columns, target, trees, depth, *rest):
        given.append((trees, depth))
        return real(df, columns, target, 2, depth, *rest)

    monkeypatch.setattr(forest, "train", fewer)
    r2 = {r.split: r.r2 for r in catalog.QUERIES["random_forest"](spark, sf_dir).collect()}
    assert r2["train"] > r2["test"] and sum(r.importance for r in catalog.QUERIES["tree_importances"](spark, sf_dir).collect()) == pytest.approx(1.0)
    assert given == [(100, None)] * 2


def test_odd_tables_grown_to_the_end(spark, data):  # noqa: F811
    same = trees.random_forest(data.withColumn("y", F.lit(2.5)), SPEC, trees=2)
    assert same.transform(data).where("prediction <> 2.5").isEmpty()
    holes = data.withColumn("x", F.when(F.col("id") % 2 == 0, F.col("x"))).withColumn("crop", F.when(F.col("id") % 3 > 0, F.col("crop")))
    scored = trees.random_forest(holes, SPEC, trees=2).transform(holes)
    assert scored.where("prediction is not null").count() == data.count() and scored.columns == [*holes.columns, "prediction"]
    assert trees.random_forest(data.limit(1), SPEC, trees=3).transform(data.limit(5)).count() == 5


def test_a_task_keeps_rows_not_their_places_in_all_trees(spark, data, monkeypatch):  # noqa: F811
    """What lies between passes is the binned rows alone, whatever the number of trees."""
    held = forest.HELD
    assert held <= 64 << 20 and set(forest.Rows.__dataclass_fields__) == {"place", "codes", "fold", "y"}


def test_passes_of_boosted_trees_carry_codes_and_residuals_alone(spark, data, monkeypatch):  # noqa: F811
    """A column that no model splits, targets, and folds where none is left out are not written with the residuals again."""
    carried = []
    real = boosting._errors
    monkeypatch.setattr(boosting, "_errors", lambda state, *rest: carried.append(state.first()) or real(state, *rest))
    found = trees.boosted_trees_categorical(data, SPEC, rounds=5, depth=2, key=["id"])
    block = carried[0]
    assert len(block.codes) == len(found.columns) == 4 and not len(block.y) and not len(block.fold) and len(block.left_over) == 1
    run = experiments.cross_validate(data, SPEC, "boosted_trees", folds=3, rounds=3, least=5)
    for r in run.metrics.collect():
        scored = run.models[r.fold].transform(data).withColumn("held", F.col("fold") == r.fold)
        for m in stats.regression_metrics(scored, "y", "prediction", ["held"]).collect():
            side = "val" if m.held else "train"
            assert [r[f"{side}_{name}"] for name in ("rows", "r2", "mae", "rmse")] == pytest.approx([m[name] for name in ("rows", "r2", "mae", "rmse")], abs=1e-9)
