"""Missing values, tied keys, files of different headers, exact medians, any fitted model."""

import math

import pytest
from pyspark.sql import functions as F

from tilth.functions.columns import two_sided_p
from tilth.operators import features, quantiles, sampling, scoring, trees
from tilth.operators.gram import FeatureSpec
from tilth.operators.linear import LinearModel
from tilth.operators.ranking import best_of
from tilth.sources.tables import read_table

MODEL = LinearModel(1.0, {"x": (2.0, 0.0, 1.0)}, {"wet": 0.5}, {"crop": {"a": 1.0, "b": -9.0}})


@pytest.mark.parametrize("missing", ["x", "wet", "crop"])
def test_a_missing_feature_is_never_a_prediction(spark, missing):
    row = {"x": 1.5, "wet": True, "crop": "a"}
    rows = spark.createDataFrame([{**row, "id": 1}, {**row, missing: None, "id": 2}], "id int, x double, wet boolean, crop string")
    assert [r.predicted for r in scoring.predict(rows, MODEL).orderBy("id").collect()] == [5.5, None]
    lists = [r.recommendations for r in scoring.recommend(rows, MODEL, ["a", "b"], "crop").orderBy("id").collect()]
    assert [(e.crop, e.predicted) for e in lists[0]] == [("a", 5.5), ("b", 0.0)]
    assert (lists[1] is None) == (missing != "crop")


def test_unknown_levels_still_count_as_nothing(spark):
    rows = spark.createDataFrame([(1.5, True, "new")], "x double, wet boolean, crop string")
    assert scoring.predict(rows, MODEL).first().predicted == 4.5


def test_any_fitted_pipeline_predicts_and_recommends(spark):
    data = [(float(i), i % 2 == 0, "abc"[i % 3], float(i % 3)) for i in range(60)]
    rows = spark.createDataFrame(data, "x double, wet boolean, crop string, y double").withColumn("id", F.monotonically_increasing_id())
    model = trees.random_forest(rows, FeatureSpec(("x",), ("wet",), ("crop",), "y"), trees=5, depth=4)
    got = scoring.predict_explained(rows, model)
    assert got.columns == [*rows.columns, "predicted", "base_value", "contributions"]
    assert all(r.contributions == [] for r in got.collect())
    ranked = scoring.recommend_by_pipeline(rows.drop("crop"), model, ["a", "b", "c"], ["id"], "crop").collect()
    assert len(ranked) == 180 and {r.crop for r in ranked if r["rank"] == 1} == {"c"}
    assert all((r["rank"] == 1) == (r.label == "best") for r in ranked)
    with pytest.raises(ValueError):
        trees.random_forest(rows, FeatureSpec(("x",), ("wet",), ("crop",), "y"), depth=31)


def test_target_encoded_categories_are_numbers_to_trees(spark):
    data = [("abcdefgh"[i % 8], float(100 * (i % 8))) for i in range(400)]
    rows = spark.createDataFrame(data, "crop string, y double")
    model = trees.boosted_trees_categorical(rows, FeatureSpec((), (), ("crop",), "y"), rounds=20, rate=0.5, depth=3, encoding="target")
    assert model.transform(rows).select(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 20


def test_samples_of_tied_keys_do_not_depend_on_storage(spark):
    base = spark.createDataFrame([(i, i % 3, f"v{i % 40}") for i in range(240)], "id int, k int, v string")
    picks, splits = set(), set()
    for parts in (1, 3, 9):
        df = base.repartition(parts, "v")
        picks.add(tuple(sorted(r.id for r in sampling.sample_n(df, 50, ["k"]).collect())))
        splits.add(tuple(sorted((r.id, r.split) for r in sampling.stratified_split(df, ["v"], ["k"]).collect())))
    assert len(picks) == len(splits) == 1 and len(next(iter(picks))) == 50


def test_samples_of_equal_rows_have_their_size(spark):
    df = spark.createDataFrame([(1, "x")] * 30 + [(1, "y")] * 30, "k int, v string").repartition(7)
    assert sampling.sample_n(df, 17, ["k"]).count() == 17


def test_digits_follow_the_number_of_strata(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 300).alias("s"))
    drawn = sampling.stratified_sample(df, ["s"], 900, ["id"])
    assert [r["count"] for r in drawn.groupBy("s").count().collect()] == [3] * 300


def test_files_of_another_column_order_are_refused(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("a,b\n1,2\n")
    (folder / "b.csv").write_text("a,b\n3,4\n")
    schema = "b int, a int"
    assert sorted((r.a, r.b) for r in read_table(spark, str(folder), schema).collect()) == [(1, 2), (3, 4)]
    (folder / "c.csv").write_text("b,a\n20,10\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_table(spark, str(folder), schema).collect()


def test_imputed_median_is_the_median(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (4.0, None), (9.0, 7.0), (None, None)], "a double, b double")
    got = features.impute_median(df, ["a", "b"]).collect()
    assert got[4].a == 3.0 and got[0].b == 6.0
    assert features.impute_median(df.where("a IS NULL"), ["a"]).first().a is None


def test_quantiles_count_before_one_task_ranks(spark, capsys):
    df = spark.range(1000).select((F.col("id") % 10).cast("double").alias("v"))
    quantiles.quantiles(df, "v", [0.5]).explain()
    plan = capsys.readouterr().out
    assert plan.index("SinglePartition") < plan.index("hashpartitioning(")
    assert quantiles.quantiles(df, "v", [0.25, 0.5]).first()[0] == [2.0, 4.5]


@pytest.mark.parametrize("dof", [1, 2, 3, 4, 199, 200, 201, 1000, 100_000])
@pytest.mark.parametrize("t", [0.0, 0.3, 1.0, 1.96, 3.5, 6.0])
def test_p_values_of_any_size(spark, dof, t):
    got = spark.range(1).select(two_sided_p(F.lit(t), F.lit(dof)).alias("p")).first().p
    scale = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    steps = 20_000
    area = sum(
        (1 + ((i + 0.5) * t / steps) ** 2 / dof) ** (-(dof + 1) / 2) for i in range(steps)
    ) * t / steps * scale
    assert got == pytest.approx(1 - 2 * area, abs=2e-7)


def test_best_of_takes_the_first_of_equal_scores(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 2), ("a", 2.0, 1), ("b", None, 1), (None, 5.0, 1)], "g string, s double, i int")
    assert sorted((r.g or "", r.s, r.i) for r in best_of(df, ["g"], "s", ["i"]).collect()) == [("", 5.0, 1), ("a", 2.0, 1)]
