"""First axes without a p x p matrix against the dense route."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilth import catalog
from tilth.operators import multivariate
from tilth.operators.multivariate import _leading


def table(spark, n=500):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(n, 2))
    rows = [
        (float(a + 0.1 * e), float(a - b), float(b + 1e6), 4.0, f"g{int(abs(a) * 9) % 7}", int(abs(b) * 5) % 4, i % 3 == 0)
        for i, ((a, b), e) in enumerate(zip(base, rng.normal(size=n)))
    ]
    return spark.createDataFrame(rows, "x double, y double, z double, flat double, g string, h int, b boolean").repartition(4)


def same(a, b):
    assert a.features == b.features and a.inertia == pytest.approx(b.inertia, abs=1e-7)
    assert a.values == pytest.approx(b.values, abs=1e-7)
    assert np.abs(a.vectors) == pytest.approx(np.abs(b.vectors), abs=1e-5)


def test_leading_axes_are_those_of_the_dense_routes(spark):
    df = table(spark)
    same(multivariate.leading_axes(df, ["x", "y", "z", "flat", "b"], k=2), multivariate.pca(df, ["x", "y", "z", "flat", "b"], k=2))
    same(multivariate.leading_axes(df, ["x", "y", "z"], ["g", "h"], k=3), multivariate.famd(df, ["x", "y", "z"], ["g", "h"], k=3))


def test_missing_and_empty_tables_are_refused(spark):
    df = table(spark, 20)
    with pytest.raises(ValueError, match="lack"):
        multivariate.leading_axes(df.withColumn("x", F.when(F.col("x") > 0, F.col("x"))), ["x"], ["g"])
    with pytest.raises(ValueError, match="no rows"):
        multivariate.leading_axes(df.limit(0), ["x"])
    with pytest.raises(ValueError, match="levels"):
        multivariate.leading_axes(df, ["x"], ["g"], max_levels=2)


@pytest.mark.parametrize("p", [3, 40, 300])
def test_krylov_steps_find_the_largest_eigenvalues(p):
    rng = np.random.default_rng(p)
    a = rng.normal(size=(p, p))
    a = a @ a.T / p
    seen = []
    values, vectors = _leading(lambda q: seen.append(q.shape[1]) or a @ q, p, min(3, p), 7, 1e-9, 100)
    assert values == pytest.approx(np.linalg.eigvalsh(a)[::-1][:3], rel=1e-9)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-6 * values[0]
    assert max(seen) <= 7


def test_equal_eigenvalues_and_a_zero_matrix():
    values, _ = _leading(lambda q: q, 50, 3, 1, 1e-9, 10)
    assert values == pytest.approx([1, 1, 1])
    values, _ = _leading(lambda q: 0 * q, 50, 3, 1, 1e-9, 10)
    assert values == pytest.approx([0, 0, 0])


def test_query_of_leading_axes_equals_the_dense_eigenvalues(spark, sf_dir):
    got = [r.eigenvalue for r in catalog.QUERIES["pca_leading"](spark, sf_dir).orderBy("component").collect()]
    vectors = [r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    x = np.array([v for v in vectors if v is not None and not any(e is None for e in v)], float)
    assert got == pytest.approx(np.linalg.eigvalsh(np.corrcoef(x.T))[::-1][:5], abs=1e-5)
