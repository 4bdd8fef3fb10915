import pytest
from pyspark.sql import functions as F

from tilth.operators import aggregates, clean, joins, ranking
from tilth.session import local_if_small, spread
from tilth.sources import models, reports, runs, tables


def values(df, name):
    return [r[name] for r in df.collect()]


def test_name_with_leading_space_and_name_listed_twice(spark):
    df = spark.createDataFrame([(1, "x")], [" Area", "b"])
    assert clean.rename_columns(df, {" Area": "Area"}).columns == ["Area", "b"]
    assert clean.drop_columns(df, ["b", "b"]).columns == [" Area"]


def test_bad_text_becomes_null_and_null_fails_a_bound(spark):
    df = clean.coerce_numeric(spark.createDataFrame([("1.5",), ("..",), (" 2 ",), ("-3",)], ["v"]), "v")
    assert values(df, "v") == [1.5, None, 2.0, -3.0]
    assert values(clean.filter_valid(df, "v"), "v") == [1.5, 2.0]


def test_mapping_to_none_and_unlisted(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], ["k"])
    assert values(clean.map_values(df, "k", {"a": "A", "b": None}), "k") == ["A", None, None, None]
    long = {f"k{i}": f"v{i}" for i in range(300)}
    many = spark.createDataFrame([("k299",), ("zz",)], ["k"])
    assert values(clean.map_values(many, "k", long).orderBy(F.col("k").desc()), "k") == ["v299", None]


def test_negated_membership_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], ["k"])
    assert values(clean.filter_in(df, "k", ["a"], negate=True), "k") == ["b", None]


def test_duplicates_of_a_hot_row(spark):
    rows = [("hot",)] * 1000 + [(f"r{i}",) for i in range(50)] + [("twin",)] * 2
    df = spark.createDataFrame(rows, ["k"])
    assert values(clean.count_duplicates(df), "duplicate_rows") == [1000]
    every = clean.list_duplicates(df, chunk=64)
    assert sorted(values(every, "k")) == ["hot"] * 1000 + ["twin"] * 2
    assert values(clean.list_duplicates(df, ["k"], n=5), "k") == ["hot"] * 5


def test_missing_columns_are_named(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    spark.createDataFrame([(1, "x")], ["a", "b"]).write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="missing_one"):
        tables.read_table(spark, path, "a int, missing_one string")
    with pytest.raises(ValueError, match="missing_two"):
        tables.read_table(spark, path, "a int", required=["missing_two"])
    swapped = tables.read_table(spark, path, "b string, a int", required=["a"])
    assert swapped.collect()[0].asDict() == {"b": "x", "a": 1}


def test_corrupt_csv_row_is_kept(spark, tmp_path):
    path = str(tmp_path / "bad.csv")
    with open(path, "w") as f:
        f.write("a,b\n1,x\nnope,y\n")
    df = tables.read_table(spark, path, "a int, b string", keep_corrupt=True).cache()
    assert [(r.a, r.b, r._corrupt_record) for r in df.collect()] == [(1, "x", None), (None, "y", "nope,y")]


def test_reports_keep_nested_values(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    reports.write_report(df, str(tmp_path / "r.csv"), "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "r.csv"))
    assert back.collect()[0]["b"] == "[1,2]"
    doc = reports.as_document(spark.createDataFrame([(1, None)], "a int, b string")).collect()[0][0]
    assert doc == '{"a":1,"b":null}'


def test_model_path_must_exist(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no saved model"):
        models.load_model(spark, str(tmp_path / "nothing"))


def test_run_records_round_trip(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i, score in enumerate((0.5, 0.9)):
        runs.log_run(runs.run_records(spark, f"r{i}", "m", {"alpha": i}, {"r2": score}, {"ids": {"a": 1}}), path)
    table = spark.read.parquet(path)
    best = runs.run_leaderboard(runs.run_metrics(table, ["r2"]), "r2", 1).collect()[0]
    assert (best["run_id"], best["r2"]) == ("r1", 0.9)
    assert table.where("kind = 'tag'").select("value").first()[0] == '{"a": 1}'


def test_enrichment_keeps_rows_and_refuses_repeated_keys(spark):
    fact = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    profile = spark.createDataFrame([("a", 1.0)], "k string, p double")
    assert sorted(joins.enrich_left(fact, profile, "k").collect(), key=lambda r: r.v)[1]["p"] is None
    assert joins.enrich_left(fact, profile, "k").count() == 3
    assert joins.enrich_left(fact, profile, "k", max_rows=0).count() == 3  # the shuffle route
    with pytest.raises(ValueError, match="several rows"):
        joins.enrich_left(fact, profile.union(profile), "k")


def test_null_keys_make_no_group(spark):
    df = spark.createDataFrame([("a", True, 1.0), (None, False, 2.0), ("a", False, 3.0)], "k string, f boolean, v double")
    assert aggregates.parcel_profile(df, "k", {"f": "rate", "v": "mean"}).collect() == [("a", 0.5, 2.0)]
    assert aggregates.value_counts(df, "k").collect() == [("a", 2, 1.0)]


def test_ranking_ties_and_top(spark):
    df = spark.createDataFrame([("x", 1.0, 0), ("x", 2.0, 1), ("x", 2.0, 2)], "id string, s double, pos int")
    ranked = ranking.rank_candidates(df, ["id"], "s", "pos").orderBy("rank").collect()
    assert [r["pos"] for r in ranked] == [1, 2, 0]
    assert sorted(values(ranking.without_top(df, "s", ["id", "pos"], 1), "pos")) == [0, 2]
    assert ranking.best_of(df, ["id"], "s", ["pos"]).collect()[0]["pos"] == 1


def test_running_contributions_long(spark):
    df = spark.createDataFrame([(1, 0, 2.0, 10.0), (1, 1, -1.0, 10.0), (1, 2, 4.0, 10.0)], "id int, o int, v double, base double")
    assert values(ranking.running_contributions(df, ["id"], "o", "v", "base").orderBy("o"), "start") == [10.0, 12.0, 11.0]


def test_small_and_large_inputs(spark):
    few = spark.range(10).coalesce(1)
    assert spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 1000, 1, 16)
    assert spread(many).rdd.getNumPartitions() == 16
    assert local_if_small(many, 10).count() == 1000
