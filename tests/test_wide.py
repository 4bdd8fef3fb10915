"""Ridge over wide categories and correlations of many columns with holes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilth import catalog
from tilth.operators import linear, stats, wide
from tilth.operators.gram import FeatureSpec


def rows(n=400):
    return [((i * 7) % 23, f"s{(i * i) % 11 if i % 3 else 0}", float(i % 17), i % 2 == 0, math.sin(i) * 3 + (i * 7) % 23 - (i % 17) * 0.3) for i in range(n)]


SHAPE = "part int, `s` string, x double, b boolean, y double"


@pytest.mark.parametrize("cats", [("part",), ("part", "s")])
def test_wide_ridge_equals_the_dense_one(spark, cats):
    df = spark.createDataFrame(rows(), SHAPE)
    spec = FeatureSpec(("x",), ("b",), cats, "y")
    for alpha in (0.5, 30.0):
        dense, found = linear.ridge(df, spec, alpha), wide.ridge_wide(df, spec, alpha)
        assert found.intercept == pytest.approx(dense.intercept, abs=1e-7)
        assert found.numerics["x"] == pytest.approx(dense.numerics["x"], abs=1e-7)
        assert found.booleans["b"] == pytest.approx(dense.booleans["b"], abs=1e-7)
        got = {(r.parent, r.level): r.coef for r in found.levels.collect()}
        assert got == pytest.approx({(p, k): c for p, lv in dense.levels.items() for k, c in lv.items()}, abs=1e-7)
        if len(cats) == 1:
            assert found.iterations <= 2 * 3 + 3  # as many as the few unknowns allow


def test_wide_model_scores_rows(spark):
    df = spark.createDataFrame(rows(), SHAPE)
    spec = FeatureSpec(("x",), ("b",), ("part", "s"), "y")
    dense, found = linear.ridge(df, spec, 1.0), wide.ridge_wide(df, spec, 1.0)
    new = spark.createDataFrame([(3, "s1", 2.0, True, 7), (99, "new", 1.0, False, 8), (None, "s1", 1.0, True, 9)], "part int, s string, x double, b boolean, coef0 int")
    out = found.transform(new)
    assert out.columns == [*new.columns, "prediction"]
    want = {r.coef0: r.p for r in new.withColumn("p", dense.raw()).collect()}
    got = {r.coef0: r.prediction for r in out.collect()}
    assert got[9] is None and want[9] is None
    assert got[7] == pytest.approx(want[7], abs=1e-6) and got[8] == pytest.approx(want[8], abs=1e-6)


def test_wide_ridge_refuses_what_it_cannot_solve(spark):
    df = spark.createDataFrame(rows(30), SHAPE)
    spec = FeatureSpec(categoricals=("part",), target="y")
    with pytest.raises(ValueError, match="positive"):
        wide.ridge_wide(df, spec, 0.0)
    with pytest.raises(ValueError, match="no rows"):
        wide.ridge_wide(df.limit(0), spec)
    with pytest.raises(ValueError, match="lack"):
        wide.ridge_wide(df.unionByName(df.limit(1).withColumn("part", F.lit(None).cast("int"))), spec)
    with pytest.raises(RuntimeError, match="iterations"):
        wide.ridge_wide(df, FeatureSpec(("x",), ("b",), ("part", "s"), "y"), 0.01, iterations=1)
    flat = wide.ridge_wide(df.withColumn("y", F.lit(2.0)), spec)
    assert flat.intercept == 2.0 and {r.coef for r in flat.levels.collect()} == {0.0}


def holed(p, n, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + rng.normal(size=(n, 1)) + 1e4
    x[rng.random((n, p)) < 0.2] = np.nan
    x[:, 1] = 5.0
    x[:, 2] = np.where(np.isnan(x[:, 0]), x[:, 2], 7.0)  # constant wherever column 0 is known
    return x


def test_blocks_of_many_columns_equal_pairwise_correlations(spark):
    p, n = 40, 300
    x = holed(p, n)
    names = [f"v{i}" for i in range(p)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in names)).repartition(5)
    found = {(r.x, r.y): r.r for r in stats.corr_matrix(df, names).collect()}
    assert len(found) == p * p
    for i in range(p):
        for j in range(p):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            got = found[names[i], names[j]]
            if np.ptp(a) == 0 or np.ptp(b) == 0:
                assert got is None, (i, j)
            else:
                assert got == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)


def test_blocks_of_nothing(spark):
    names = [f"v{i}" for i in range(stats.MANY + 1)]
    df = spark.createDataFrame([], ", ".join(f"{c} double" for c in names))
    assert {r.r for r in stats.corr_matrix(df, names).collect()} == {None}
    one = spark.createDataFrame([tuple(float(i) for i in range(len(names)))], ", ".join(f"{c} double" for c in names))
    assert {r.r for r in stats.corr_matrix(one, names).collect()} == {None}


def test_the_query_of_two_wide_categories_equals_the_dense_ridge(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    dense = linear.ridge(df, FeatureSpec(("l_quantity",), (), ("l_partkey", "l_suppkey"), "l_extendedprice"), 5.0)
    got = {(r.parent, r.level): r.coef for r in catalog.QUERIES["ridge_wide_pair"](spark, sf_dir).collect()}
    assert got == pytest.approx({(p, k): c for p, lv in dense.levels.items() for k, c in lv.items()}, abs=2e-4)


@pytest.mark.parametrize("most", [wide.HELD_LEVELS, 5])
def test_three_categories_on_the_driver_or_in_a_table(spark, monkeypatch, most):
    monkeypatch.setattr(wide, "HELD_LEVELS", most)
    df = spark.createDataFrame([(*r, f"t{(i * i * 3) % 13}") for i, r in enumerate(rows())], SHAPE + ", t string")
    spec = FeatureSpec(("x",), ("b",), ("t", "part", "s"), "y")
    dense, found = linear.ridge(df, spec, 2.0), wide.ridge_wide(df, spec, 2.0)
    assert found.intercept == pytest.approx(dense.intercept, abs=1e-7)
    got = {(r.parent, r.level): r.coef for r in found.levels.collect()}
    assert got == pytest.approx({(p, k): c for p, lv in dense.levels.items() for k, c in lv.items()}, abs=1e-7)


def test_cells_are_shuffled_once_however_many_iterations(spark, monkeypatch):
    monkeypatch.setattr(wide, "_with_others", None)
    written, real = [], wide.staged
    monkeypatch.setattr(wide, "staged", lambda df, label: written.append(label) or real(df, label))
    found = wide.ridge_wide(spark.createDataFrame(rows(), SHAPE), FeatureSpec(("x",), ("b",), ("part", "s"), "y"), 0.5)
    assert found.iterations > 2 and written == ["blocks"]
