import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilth.operators import aggregates, distribution, sampling
from tilth.operators.quantiles import quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def table(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "v double")


@pytest.mark.parametrize(
    "xs",
    [
        np.random.default_rng(1).normal(size=700),
        np.concatenate([np.full(400, 3.25), np.random.default_rng(2).lognormal(0, 8, 500)]),
        np.concatenate([[1e300, -1e300], np.arange(300) / 7]),
        1e9 + np.random.default_rng(3).integers(0, 90, 400) * 1e-6,
        np.full(200, 5.0),
    ],
    ids=["normal", "copies and heavy tail", "outliers", "offset", "constant"],
)
@pytest.mark.parametrize("bins", [7, 1000])
def test_refinement_is_exact(spark, xs, bins):
    got = quantiles(table(spark, xs), "v", PROBS, max_states=0 if len(set(xs)) == 1 else 20, bins=bins).collect()[0][0]
    np.testing.assert_allclose(got, np.quantile(xs, PROBS), rtol=1e-12, atol=1e-12)


def test_refinement_for_the_large_groups_only(spark):
    rng = np.random.default_rng(5)
    groups = {"big": rng.normal(size=900), "small": rng.integers(0, 5, 300).astype(float), None: rng.normal(size=800)}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("big", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r["quantiles"] for r in quantiles(df, "v", PROBS, ["k"], max_states=50, bins=11).collect()}
    assert set(got) == {"big", "small", None}
    for k, xs in groups.items():
        np.testing.assert_allclose(got[k], np.quantile(xs, PROBS), rtol=1e-12)


def test_describe_both_routes(spark):
    xs = np.random.default_rng(8).gamma(2.0, 3.0, 500)
    df = table(spark, xs).withColumn("w", F.floor("v"))
    a = aggregates.describe(df, ["v", "w"]).orderBy("column_name").collect()
    b = aggregates.describe(df, ["v", "w"], max_states=40).orderBy("column_name").collect()
    for x, y in zip(a, b):
        np.testing.assert_allclose([float(v) for v in x[1:]], [float(v) for v in y[1:]], rtol=1e-12)
    np.testing.assert_allclose(a[0]["std"], np.std(xs, ddof=1))


def test_kde_against_brute_force(spark):
    xs = np.random.default_rng(4).normal(3, 2, 400)
    h = xs.std(ddof=1) * len(xs) ** -0.2
    grid = np.linspace(xs.min(), xs.max(), 50)
    truth = np.exp(-0.5 * ((grid[:, None] - xs) / h) ** 2).sum(1) / (len(xs) * h * math.sqrt(2 * math.pi))
    exact = distribution.kde_grid(table(spark, xs), "v", 50, bins=None).orderBy("point").collect()
    np.testing.assert_allclose([r["density"] for r in exact], truth, rtol=1e-9)
    binned = distribution.kde_grid(table(spark, xs), "v", 50).orderBy("point").collect()
    np.testing.assert_allclose([r["density"] for r in binned], truth, atol=1e-4)


def test_histogram_keeps_all_rows_and_merged_edges(spark):
    df = table(spark, [0, 0, 0, 0, 0, 0, 1, 2, 3, 10])
    assert sum(r["count"] for r in distribution.histogram(df, "v", 4).collect()) == 10
    trend = distribution.quantile_trend(df.withColumn("y", F.col("v")), "v", "y", 4).orderBy("bin").collect()
    assert sum(r["rows"] for r in trend) == 10 and trend[0]["lo"] == 0.0


def keyed(spark, n, parts=4):
    return spark.range(0, n, 1, parts).withColumn("s", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")))


def test_sample_is_exact_and_repeatable(spark):
    df = keyed(spark, 2000)
    first = {r["id"] for r in sampling.sample_n(df, 137, ["id"], 7).collect()}
    again = {r["id"] for r in sampling.sample_n(df.repartition(9), 137, ["id"], 7).collect()}
    assert len(first) == 137 and first == again
    assert sampling.sample_n(df, 5000, ["id"]).count() == 2000
    assert sampling.sample_n(df, 0, ["id"]).count() == 0


def test_strata_get_equal_quotas(spark):
    df = keyed(spark, 700).unionByName(spark.createDataFrame([(10_000, None)], "id bigint, s string"))
    sizes = Counter(r["s"] for r in df.collect())
    got = Counter(r["s"] for r in sampling.stratified_sample(df, ["s"], 490, ["id"]).collect())
    assert got == {s: min(n, 490 // 8) for s, n in sizes.items() if s is not None}


@pytest.mark.parametrize("digits, max_hashes", [(3, 1_000_000), (1, 2)])
def test_copies_are_split_exactly(spark, digits, max_hashes):
    """Half of the rows share one key; every size still comes out exactly."""
    df = spark.range(0, 600, 1, 6).select((F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id"))).alias("k"))

    def targets(sizes, keys):
        return sizes.select(*keys, F.inline(F.array(
            F.struct(F.lit(0).alias("cut"), F.lit(100).cast("bigint").alias("pos")),
            F.struct(F.lit(1).alias("cut"), F.lit(350).cast("bigint").alias("pos")),
        )))

    parts = sampling.split_at(df, ["k"], 1, targets, digits=digits, max_hashes=max_hashes)
    assert Counter(r["part"] for r in parts.collect()) == {0: 100, 1: 250, 2: 250}
    assert Counter(r["k"] for r in parts.collect()) == Counter(r["k"] for r in df.collect())


def test_narrowing_changes_no_row(spark):
    df = keyed(spark, 1500)

    def targets(sizes, keys):
        return sizes.select(*keys, F.lit(0).alias("cut"), F.expr("size div 3").alias("pos"))

    def first_part(**how):
        return {r["id"] for r in sampling.split_at(df, ["id"], 3, targets, ["s"], **how).where("part = 0").collect()}

    assert first_part() == first_part(digits=1, max_hashes=1)


def test_split_shares_and_totals(spark):
    df = keyed(spark, 997)
    parts = sampling.stratified_split(df, ["s"], ["id"])
    rows = parts.collect()
    n_test = math.ceil(997 * 0.15)
    n_val = math.ceil((997 - n_test) * 0.1765)
    assert Counter(r["split"] for r in rows) == {"test": n_test, "val": n_val, "train": 997 - n_test - n_val}
    sizes = Counter(r["s"] for r in rows)
    for s, n in sizes.items():
        got = sum(1 for r in rows if r["s"] == s and r["split"] == "test")
        assert abs(got - n * n_test / 997) <= 1


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 60), k=st.integers(2, 7), seed=st.integers(0, 99))
def test_exact_folds(spark, n, k, seed):
    folds = sampling.assign_folds(spark.range(n), k, ["id"], seed, exact=True)
    sizes = Counter(r["fold"] for r in folds.collect())
    assert [sizes.get(i, 0) for i in range(k)] == [n // k + (i < n % k) for i in range(k)]


def test_random_split_sizes(spark):
    df = spark.range(103)
    exact = Counter(r["split"] for r in sampling.random_split(df, 0.2, ["id"]).collect())
    assert exact == {"test": 21, "train": 82}
    loose = sampling.random_split(spark.range(20_000), 0.2, ["id"], exact=False)
    assert abs(loose.where("split = 'test'").count() - 4000) < 300
