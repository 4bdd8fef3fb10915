"""Joins that neither sort nor repeat the fact table."""

import pytest

from tilth import catalog
from tilth.operators.linear import LinearModel, path_errors
from tilth.sources import views


def test_shuffled_fact_rows_are_joined_without_a_sort(spark, sf_dir):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for name in names:
            spark.conf.set(name, "-1")
        df = views.parcels(spark, sf_dir)
        assert df.count() == df.distinct().count()
        df = df.select("l_orderkey", "crop", "yield_t")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for name in names:
            spark.conf.unset(name)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_the_panel_is_written_once_before_it_is_read_again(spark, sf_dir, monkeypatch):
    for name in ("forward_merge", "predict_with_missing", "ablate_enrichment"):
        labels, staged = [], views.staged
        with monkeypatch.context() as patch:
            patch.setattr(views, "staged", lambda df, label: labels.append(label) or staged(df, label))
            catalog.QUERIES[name](spark, sf_dir)
        assert labels.count("panel") == 1, name


def test_rows_do_not_meet_by_fold_to_be_scored_by_a_search(spark):
    df = spark.createDataFrame([(i % 5, float(i), float(i * i % 7)) for i in range(50)], "fold int, x double, y double")
    paths = {k: [LinearModel(0.5, {"x": (float(t), 1.0, 2.0)}) for t in range(3)] for k in range(5)}
    found = path_errors(df, paths, "fold", "y")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    got = {(r.trial, r.fold): r.mae for r in found.collect()}
    assert len(got) == 15
    for (t, k), mae in got.items():
        errors = [abs(i * i % 7 - 0.5 - t * (i - 1.0) / 2.0) for i in range(50) if i % 5 == k]
        assert mae == pytest.approx(sum(errors) / len(errors))
