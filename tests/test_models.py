import numpy as np
import pytest
from pyspark.sql import functions as F

from tilth import catalog
from tilth.functions.columns import safe_corr, two_sided_p
from tilth.operators import aggregates, explain, features, linear, multivariate, ranking, scoring, stats, trees
from tilth.operators.gram import FeatureSpec, collect_gram
from tilth.operators.linear import LinearModel
from tilth.plans import experiments
from tilth.sources import models, views

# fixed values: the small training frame and the record scored in the behaviour tests
TRAIN = [
    (200.0, 15.0, 90, True, True, "West", "Loam", "Wheat", "Sunny", 3.2),
    (500.0, 20.0, 110, False, True, "East", "Clay", "Rice", "Rainy", 4.5),
    (800.0, 25.0, 130, True, False, "North", "Sandy", "Maize", "Cloudy", 5.1),
    (950.0, 30.0, 150, True, True, "South", "Silt", "Barley", "Sunny", 6.8),
    (300.0, 18.0, 100, False, False, "West", "Loam", "Wheat", "Rainy", 3.9),
]
RECORD = (850.0, 24.5, 120, True, True, "West", "Loam", "Wheat", "Sunny")
SCHEMA = (
    "rainfall double, temperature double, days int, fertilizer boolean, irrigation boolean, "
    "region string, soil string, crop string, weather string"
)
SPEC = FeatureSpec(
    ("rainfall", "temperature", "days"), ("fertilizer", "irrigation"), ("region", "soil", "crop", "weather"), "y"
)


def design(rows, levels):
    x = np.array([[r[0], r[1], r[2]] for r in rows], float)
    return x, np.array(
        [[*map(float, r[3:5]), *[float(r[5 + i] == lv) for i, ls in enumerate(levels) for lv in ls]] for r in rows]
    )


@pytest.fixture(scope="module")
def fitted(spark):
    return linear.ridge(spark.createDataFrame(TRAIN, SCHEMA + ", y double"), SPEC, 1.0)


def test_ridge_equals_a_direct_solve(spark, fitted):
    levels = [sorted({r[5 + i] for r in TRAIN}) for i in range(4)]
    num, rest = design(TRAIN, levels)
    mean, sd = num.mean(0), num.std(0)
    x = np.hstack([(num - mean) / sd, rest])
    y = np.array([r[9] for r in TRAIN])
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ yc)
    num1, rest1 = design([RECORD], levels)
    expected = float(((np.hstack([(num1 - mean) / sd, rest1]) - x.mean(0)) @ beta)[0] + y.mean())
    got = spark.createDataFrame([RECORD], SCHEMA).select(fitted.raw().alias("p")).first()["p"]
    assert got == pytest.approx(expected, abs=1e-9)


def test_contributions_add_up_and_are_grouped(spark, fitted):
    row = explain.explain(spark.createDataFrame([RECORD], SCHEMA), fitted).first()
    parts = {c["feature"]: c["contribution"] for c in row["contributions"]}
    assert row["base_value"] + sum(parts.values()) == pytest.approx(row["prediction"], abs=1e-9)
    assert set(parts) == set(SPEC.features)
    sizes = [abs(c["contribution"]) for c in row["contributions"]]
    assert sizes == sorted(sizes, reverse=True)


def test_without_a_model_contributions_are_empty(spark):
    row = explain.explain(spark.createDataFrame([RECORD], SCHEMA), None).first()
    assert row["contributions"] == [] and row["base_value"] == 0.0


def test_unknown_level_contributes_nothing(spark, fitted):
    strange = spark.createDataFrame([(*RECORD[:5], "Atlantis", *RECORD[6:])], SCHEMA)
    row = explain.explain(strange, fitted).first()
    assert {c["feature"]: c["contribution"] for c in row["contributions"]}["region"] == 0.0


def test_waterfall_starts(spark, fitted):
    df = explain.explain(spark.createDataFrame([RECORD], SCHEMA), fitted)
    row = df.withColumn("bars", ranking.running_start(F.col("base_value"), F.col("contributions"))).first()
    assert row["bars"][0]["start"] == row["base_value"]
    assert row["bars"][-1]["start"] + row["bars"][-1]["height"] == pytest.approx(row["prediction"], abs=1e-9)


def test_model_round_trip(spark, fitted, tmp_path):
    path = models.save_model(spark, fitted, str(tmp_path / "model"))
    assert models.load_model(spark, path) == fitted


def test_leaking_feature_is_refused():
    with pytest.raises(ValueError, match="derived from the target"):
        FeatureSpec(numerics=("ref_yield",), target="y", banned=("ref_yield",))
    with pytest.raises(ValueError, match="derived"):
        SPEC.with_numerics(["y"])


def test_rows_with_missing_features_are_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "x double, y double")
    with pytest.raises(ValueError, match="1 rows lack"):
        collect_gram(df, FeatureSpec(numerics=("x",), target="y"))


def test_minimum_norm_least_squares(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), "uvw"[i % 3], float(2 * a + i % 3)) for i, a in enumerate(rng.normal(1e6, 1, 200))]
    spec = FeatureSpec(("x",), (), ("g",), "y")
    df = spark.createDataFrame(rows, "x double, g string, y double")
    model = linear.linear_regression(df, spec)
    err = df.select(F.max(F.abs(F.col("y") - model.raw())).alias("e")).first()["e"]
    assert err < 1e-5 and abs(sum(model.levels["g"].values())) < 1e-6


def test_full_ridge_on_parcels(spark, sf_dir):
    spec = FeatureSpec(tuple(views.NUMERICS), tuple(views.BOOLEANS), tuple(views.CATEGORICALS), views.TARGET)
    df = views.saved_parcels(spark, sf_dir, spec.columns)
    gram = collect_gram(df, spec)
    model = linear.solve(gram, 1.0)
    assert len(gram.features) == 2 + 24
    scores = linear.gram_scores(gram, model, gram.total())
    direct = stats.regression_metrics(df.withColumn("p", model.raw()), views.TARGET, "p").first()
    assert scores["r2"] == pytest.approx(direct["r2"], abs=1e-10) and scores["rmse"] == pytest.approx(direct["rmse"])
    by_rows = trees.ridge_by_rows(df, spec, 1.0).transform(df)
    assert by_rows.select(F.max(F.abs(F.col("prediction") - model.raw()))).first()[0] < 1e-6


def test_cells_and_entries_give_the_same_matrix(spark, sf_dir):
    spec = FeatureSpec(("rainfall_mm", "days_to_harvest"), ("fertilizer_used",), ("crop", "weather"), views.TARGET)
    df = views.saved_parcels(spark, sf_dir, spec.columns).withColumn("fold", (F.hash(*spec.columns) % 3 + 3) % 3)
    few, many = collect_gram(df, spec, "fold"), collect_gram(df, spec, "fold", max_cells=5)
    assert few.features == many.features and few.folds == many.folds
    for k in few.folds:
        np.testing.assert_allclose(few.parts[k], many.parts[k], rtol=1e-9, atol=1e-6)
    with pytest.raises(ValueError, match="too many levels"):
        collect_gram(df, spec, max_cells=5, max_entries=10)


def test_cross_validation_routes_agree(spark, sf_dir):
    spec = FeatureSpec(("rainfall_mm",), ("fertilizer_used",), ("crop",), views.TARGET)
    df = views.saved_parcels(spark, sf_dir, spec.columns).withColumn("fold", (F.hash(*spec.columns) % 3 + 3) % 3)
    run = experiments.linear_cv(df, spec)
    short = {r["fold"]: r for r in experiments.linear_cv_from_gram(spark, collect_gram(df, spec, "fold")).collect()}
    rows = run.metrics.collect()
    assert len(rows) == len(short) == 3
    for r in rows:
        assert r["val_r2"] == pytest.approx(short[r["fold"]]["val_r2"], abs=1e-10)
        assert r["train_rmse"] == pytest.approx(short[r["fold"]]["train_rmse"], abs=1e-10)
    trials = experiments.random_search(df, spec, [0.1, 1.0, 1e6]).collect()
    assert trials[0]["mean_val_r2"] >= trials[-1]["mean_val_r2"] and trials[-1]["alpha"] == 1e6
    mae = {r["trial"]: r["mean_val_mae"] for r in trials}
    assert mae[1] == pytest.approx(np.mean([r["val_mae"] for r in rows]), abs=1e-10)
    importances = experiments.importances(spark, run).collect()
    assert {r["parent"]: r["type"] for r in importances} == {
        "rainfall_mm": "coefficient", "fertilizer_used": "coefficient", "crop": "range"
    }


def test_penalty_draws_are_log_uniform():
    draws = experiments.alpha_draws(500)
    assert draws == experiments.alpha_draws(500) and min(draws) >= 1e-3 and max(draws) <= 1e2
    assert 0.3 < np.mean(np.log10(draws) < -0.5) < 0.7


def test_student_t(spark):
    known = [(2.776445, 4, 0.05), (12.706205, 1, 0.05), (4.302653, 2, 0.05), (2.262157, 9, 0.05), (1.0, 30, 0.325309)]
    df = spark.createDataFrame(known, "t double, n bigint, p double").select("p", two_sided_p(F.col("t"), F.col("n")).alias("q"))
    for r in df.collect():
        assert r["q"] == pytest.approx(r["p"], abs=1e-6)


def test_paired_test_without_variation(spark):
    df = spark.createDataFrame([(1.0, 0.5)] * 5, "a double, b double")
    row = stats.paired_ttest(df, "a", "b").first()
    assert row["t"] is None and row["p"] is None and row["difference"] == 0.5


def test_correlations_with_missing_and_constant(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(1e8, 1, 300), rng.normal(size=300)
    y = y + 0.5 * (x - 1e8)
    hole = rng.random(300) < 0.2
    rows = [(float(a), None if h else float(b), 7.0, bool(b > 0)) for a, b, h in zip(x, y, hole)]
    df = spark.createDataFrame(rows, "x double, y double, c double, f boolean")
    got = {(r["x"], r["y"]): r["r"] for r in stats.corr_matrix(df).collect()}
    assert got["x", "y"] == got["y", "x"] == pytest.approx(np.corrcoef(x[~hole], y[~hole])[0, 1], abs=1e-9)
    assert got["x", "f"] == pytest.approx(np.corrcoef(x, y > 0)[0, 1], abs=1e-9)
    assert got["c", "x"] is None and got["c", "c"] is None and got["y", "y"] == 1.0
    one = df.select(safe_corr(F.col("c"), F.col("x")).alias("r")).first()
    assert one["r"] is None


def test_scale_of_a_constant_column(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 5.0)], "c double, x double")
    assert [tuple(r) for r in stats.standardize(df, ["c", "x"]).collect()] == [(0.0, -1.0), (0.0, 1.0)]


def test_metrics_of_a_constant_target(spark):
    row = stats.regression_metrics(spark.createDataFrame([(1.0, 2.0)] * 3, "y double, p double"), "y", "p").first()
    assert row["r2"] is None and row["mae"] == 1.0


def test_skewness_is_bias_corrected(spark):
    x = np.random.default_rng(2).gamma(1.0, 1.0, 50)
    n, d = len(x), x - x.mean()
    expected = (d**3).mean() / (d**2).mean() ** 1.5 * np.sqrt(n * (n - 1)) / (n - 2)
    got = spark.createDataFrame([(float(v),) for v in x], "v double").agg(aggregates.skewness("v")).first()[0]
    assert got == pytest.approx(expected)


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3)) + [1000, 0, -5]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    axes = multivariate.pca(df, ["a", "b", "c"])
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    np.testing.assert_allclose(axes.values, values, atol=1e-9)
    z = (x - x.mean(0)) / x.std(0)
    scores = np.array([[r["PC1"], r["PC2"]] for r in axes.transform(df).select("PC1", "PC2").collect()])
    np.testing.assert_allclose(np.abs(scores[:, 0]), np.abs(z @ axes.vectors[:, 0]), atol=1e-9)
    assert axes.variance_table(spark).agg(F.max("cumulative")).first()[0] == pytest.approx(100.0)


def test_mixed_axes(spark):
    rng = np.random.default_rng(7)
    cats = rng.integers(0, 4, 500), rng.integers(0, 2, 500)
    rows = [(float(a), f"k{b}", bool(c)) for a, b, c in zip(rng.normal(size=500), *cats)]
    df = spark.createDataFrame(rows, "x double, g string, f boolean")
    axes = multivariate.famd(df, ["x"], ["g", "f"], 3)
    assert axes.inertia == pytest.approx(1 + 3 + 1)
    totals = axes.contribution_table(spark).groupBy("component").agg(F.sum("contribution").alias("t")).collect()
    assert all(r["t"] == pytest.approx(1.0) for r in totals)
    coordinates = axes.transform(df, "D").agg(F.avg("D1").alias("m"), F.var_pop("D1").alias("v")).first()
    assert coordinates["m"] == pytest.approx(0.0, abs=1e-9) and coordinates["v"] == pytest.approx(axes.values[0])


def test_indicators(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    levels = features.vocabulary(train, ["k"])
    new = features.one_hot(spark.createDataFrame([("a",), ("z",), (None,)], "k string"), ["k"], levels)
    assert [tuple(r)[1:] for r in new.collect()] == [(1, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert features.dummies(train, ["k"]).columns == ["k_b", "k_c"]


def test_unknown_level_in_a_feature_pipeline(spark):
    train = spark.createDataFrame(TRAIN, SCHEMA + ", y double")
    pipeline = features.build_features(train, SPEC)
    vector = pipeline.transform(spark.createDataFrame([(*RECORD[:5], "Atlantis", *RECORD[6:])], SCHEMA)).first()["features"]
    assert vector.size == 3 + 2 + 4 + 4 + 4 + 3 and list(vector.toArray()[5:9]) == [0.0] * 4


def test_trees_and_importances(spark, sf_dir, tmp_path):
    spec = FeatureSpec(("rainfall_mm",), ("fertilizer_used",), ("crop",), views.TARGET)
    df = views.saved_parcels(spark, sf_dir, spec.columns)
    forest = trees.random_forest(df, spec, trees=5, depth=5)
    assert stats.regression_metrics(forest.transform(df), views.TARGET, "prediction").first()["r2"] > 0.5
    ranked = trees.tree_importances(spark, forest, df, spec).collect()
    assert ranked[0]["parent"] == "rainfall_mm" and sum(r["importance"] for r in ranked) == pytest.approx(1.0)
    native = trees.boosted_trees_categorical(df, spec, rounds=3, depth=3, encoding="native")
    path = models.save_model(spark, native, str(tmp_path / "native"))
    again = models.load_pipeline(spark, path).transform(df).agg(F.sum("prediction")).first()[0]
    assert again == pytest.approx(native.transform(df).agg(F.sum("prediction")).first()[0])


def test_recommendation_equals_one_prediction_per_candidate(spark, fitted):
    context = spark.createDataFrame([RECORD], SCHEMA)
    crops = sorted(fitted.levels["crop"])
    listed = scoring.recommend(context.drop("crop"), fitted, crops, "crop").first()["recommendations"]
    single = {
        c: scoring.predict(context.withColumn("crop", F.lit(c)), fitted).first()["predicted"] for c in crops
    }
    assert {r["crop"]: r["predicted"] for r in listed} == single
    assert LinearModel(1.0).parents == []


def test_boosted_queries_run_the_defaults(spark, sf_dir, monkeypatch):
    given = []
    for name in ("boosted_trees", "boosted_trees_categorical"):
        real = getattr(trees, name)
        monkeypatch.setattr(trees, name, lambda df, spec, real=real, **kw: given.append(kw) or real(df, spec, rounds=2, depth=2))
    monkeypatch.setattr(experiments, "compare_models", lambda folds, spec, kinds, **kw: given.append(kw) or folds)
    for name in ("boosted_trees", "boosted_trees_categorical", "compare_models", "compare_models_panel"):
        catalog.QUERIES[name](spark, sf_dir)
    assert given == [{}] * 4
