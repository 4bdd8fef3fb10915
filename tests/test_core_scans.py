"""Running totals without a single task, clashing names, shared sums, and penalties in one pass."""

import pytest
from pyspark.sql import functions as F

from tilth.functions.columns import clamp_lower, unused
from tilth.operators import joins, linear, ranking, sampling, scoring
from tilth.operators.gram import FeatureSpec, collect_gram
from tilth.plans import experiments


def test_prefix_sums_equal_a_plain_loop(spark):
    rows = [(None if i % 7 == 0 else i % 13, None if i % 5 == 0 else i, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "o int, v long, part int").repartition(7)
    out = ranking.prefix_sums(df, "o", "v", "run")
    assert out.columns == ["o", "v", "part", "run"]
    got = sorted(((r.o is not None, r.o or 0), r.run or 0) for r in out.collect())
    per: dict = {}
    for o, v, _ in rows:
        per.setdefault((o is not None, o or 0), []).append(v or 0)
    upto = 0
    for key in sorted(per):
        found = [run for k, run in got if k == key]
        assert upto <= found[0] and found[-1] == upto + sum(per[key])
        upto += sum(per[key])
    assert {r.part for r in out.collect()} == set(range(2000))


def test_prefix_sums_of_a_hot_value_fill_several_ranges(spark):
    df = spark.range(6000).select(F.lit(1).alias("o"), F.lit(2).alias("v"))
    out = ranking.prefix_sums(df, "o", "v", "v")
    assert sorted(r.v for r in out.collect()) == [2 * i for i in range(1, 6001)]
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_prefix_sums_of_nothing_and_of_nulls(spark):
    empty = spark.createDataFrame([], "o int, v double")
    assert ranking.prefix_sums(empty, "o", "v").collect() == []
    some = spark.createDataFrame([(1, None), (2, 3.0), (3, None)], "o int, v double")
    assert [r.cumulative for r in ranking.prefix_sums(some, "o", "v").orderBy("o").collect()] == [None, 3.0, 3.0]


def test_samples_keep_columns_of_any_name(spark):
    names = ["_hash", "_all", "_part", "_cuts", "id"]
    df = spark.range(200).select(*[(F.col("id") * (i + 1)).alias(n) for i, n in enumerate(names)])
    plain = {r.id for r in sampling.sample_n(df.select("id"), 20, ["id"]).collect()}
    taken = sampling.sample_n(df, 20, ["id"])
    assert taken.columns == names
    assert {r.id for r in taken.collect()} == plain
    assert all(r._hash * 5 == r.id for r in taken.collect())
    by = df.withColumn("_bin", F.col("id") % 2)
    out = sampling.stratified_sample(by, ["_bin"], 10, ["_hash"])
    assert out.columns == [*names, "_bin"] and out.count() == 10
    split = sampling.random_split(df, 0.25, ["_hash"])
    assert split.columns == [*names, "split"] and split.where("split = 'test'").count() == 50


def test_nothing_to_stack_is_an_error_with_a_reason():
    with pytest.raises(ValueError, match="no tables"):
        joins.stack_results([])


def test_clamp_and_unused(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.5,), (None,), (float("nan"),)], "x double")
    assert [str(r.c) for r in df.select(clamp_lower(F.col("x")).alias("c")).collect()] == ["0.0", "0.0", "2.5", "None", "nan"]
    assert unused("a", ["A", "a_", "b"]) == "a__"


def test_recommend_names_an_input_once(spark):
    model = linear.LinearModel(1.0, {"rain": (2.0, 1.0, 3.0)}, {}, {"crop": {c: float(i) for i, c in enumerate("abcdef")}})
    df = spark.createDataFrame([(4.0, 9)], "rain double, _shared int")
    out = scoring.recommend(df, model, list("abcdef"))
    assert out.columns == ["rain", "_shared", "recommendations"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rain#") <= 6
    assert [(e.crop, e.predicted) for e in out.first().recommendations][:2] == [("f", 8.0), ("e", 7.0)]


def test_path_errors_equal_scoring_each_model(spark):
    rows = [(i % 3, float(i % 11), i % 2 == 0, "abc"[i % 3 - 1], float((i * i) % 17) + i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "fold int, x double, b boolean, c string, y double")
    spec = FeatureSpec(("x",), ("b",), ("c",), "y")
    gram = collect_gram(df, spec, "fold")
    alphas = [0.0, 0.5, 20.0]
    paths = {k: linear.solve_path(gram, alphas, leave_out=k) for k in gram.folds}
    found = {(r.trial, r.fold): r.mae for r in linear.path_errors(df, paths, "fold", "y").collect()}
    assert len(found) == 9
    for (t, k), mae in found.items():
        model = paths[k][t]
        own = df.where(F.col("fold") == k).agg(F.avg(F.abs(F.col("y") - model.raw()))).first()[0]
        assert mae == pytest.approx(own, abs=1e-12)
    table = experiments.random_search(df, spec, alphas)
    assert table.count() == 3
