import json

import pytest
from pyspark.sql import functions as F

from tilth.operators import scoring
from tilth.operators.linear import LinearModel
from tilth.operators.validation import Contract, validate
from tilth.streaming import scoring_stream

# fixed values: vocabularies, bounds, one yield per crop and a valid record
CROPS = ["Wheat", "Rice", "Maize", "Barley", "Soybean", "Cotton"]
YIELDS = {"Wheat": 5.0, "Rice": 7.0, "Maize": 3.0, "Barley": 6.0, "Soybean": 4.0, "Cotton": 2.0}
CONTRACT = Contract(
    {
        "Region": ("North", "South", "East", "West"),
        "Soil_Type": ("Sandy", "Clay", "Loam", "Silt", "Peaty", "Chalky"),
        "Weather_Condition": ("Sunny", "Rainy", "Cloudy"),
        "Crop": tuple(CROPS),
    },
    {
        "Rainfall_mm": (100.00089622522204, 999.998098221668),
        "Temperature_Celsius": (15.000034141430271, 39.99999662316004),
        "Days_to_Harvest": (60, 149),
    },
    ("Fertilizer_Used", "Irrigation_Used"),
    ("Days_to_Harvest",),
)
CONTEXT = {
    "Region": "West", "Soil_Type": "Loam", "Rainfall_mm": 850.0, "Temperature_Celsius": 24.5,
    "Fertilizer_Used": True, "Irrigation_Used": True, "Weather_Condition": "Sunny", "Days_to_Harvest": 120,
}
FAKE = LinearModel(0.0, levels={"Crop": YIELDS})
NEGATIVE = LinearModel(-3.5)


def requests(spark, *records):
    texts = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "n int, value string")
    return scoring_stream.parse_requests(texts, CONTRACT)


def found(spark, record, contract=CONTRACT):
    return scoring_stream.checked(requests(spark, record), contract).first()["reasons"]


def test_prediction_of_each_crop(spark):
    rows = requests(spark, *[{**CONTEXT, "Crop": c} for c in ("Rice", "Cotton")])
    assert [r["predicted"] for r in scoring.predict(rows, FAKE).orderBy("n").collect()] == [7.0, 2.0]


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"Crop": "Unicorn"}, "Crop:unknown value"),
        ({"Region": "Atlantis"}, "Region:unknown value"),
        ({"Rainfall_mm": -10}, "Rainfall_mm:below 100.00089622522204"),
        ({"Days_to_Harvest": 0}, "Days_to_Harvest:below 60"),
        ({"Fertilizer_Used": "yes"}, "Fertilizer_Used:wrong type"),
        ({"Temperature_Celsius": 41}, "Temperature_Celsius:above 39.99999662316004"),
        ({"Rainfall_mm": None}, "Rainfall_mm:missing"),
    ],
)
def test_rejected_records(spark, change, reason):
    assert found(spark, {**CONTEXT, "Crop": "Wheat", **change}) == [reason]


def test_missing_fields_and_valid_record(spark):
    assert found(spark, {**CONTEXT, "Crop": "Wheat"}) == []
    short = {k: v for k, v in CONTEXT.items() if k not in ("Rainfall_mm", "Soil_Type")}
    assert sorted(found(spark, {**short, "Crop": "Wheat"})) == ["Rainfall_mm:missing", "Soil_Type:missing"]


def test_all_problems_are_listed_for_a_table(spark):
    df = spark.createDataFrame([("West", "yes", 100.5), ("Mars", None, 500.0)], "Region string, Fertilizer_Used string, Days_to_Harvest double")
    contract = Contract({"Region": ("West",)}, {"Days_to_Harvest": (60, 149)}, ("Fertilizer_Used",), ("Days_to_Harvest",))
    good, bad = validate(df, contract)
    assert good.isEmpty()
    assert [r["reasons"] for r in bad.orderBy("Days_to_Harvest").collect()] == [
        ["Days_to_Harvest:not a whole number", "Fertilizer_Used:not a boolean"],
        ["Region:unknown value", "Days_to_Harvest:above 149", "Fertilizer_Used:missing"],
    ]
    absent = validate(df.drop("Region"), contract)[1].first()["reasons"]
    assert "Region:missing" in absent


def test_prediction_is_never_negative(spark):
    row = scoring.predict_explained(requests(spark, {**CONTEXT, "Crop": "Wheat"}), NEGATIVE).first()
    assert (row["predicted"], row["base_value"], row["contributions"]) == (0.0, -3.5, [])


def test_without_a_model(spark):
    df = requests(spark, {**CONTEXT, "Crop": "Wheat"})
    for call in (scoring.predict, scoring.predict_explained):
        with pytest.raises(RuntimeError, match="no model"):
            call(df, None)
    with pytest.raises(RuntimeError, match="no model"):
        scoring.recommend(df, None, CROPS, "Crop")
    with pytest.raises(RuntimeError, match="no model"):
        scoring_stream.score_stream(df, None, CONTRACT, "", "", "")


def test_recommendation_is_ranked(spark):
    df = requests(spark, CONTEXT).drop("Crop")
    assert found(spark, CONTEXT, CONTRACT.without("Crop")) == []
    listed = scoring.recommend(df, FAKE, CROPS, "Crop").first()["recommendations"]
    assert [r["Crop"] for r in listed] == ["Rice", "Barley", "Wheat", "Soybean", "Maize", "Cotton"]
    assert [r["rank"] for r in listed] == [1, 2, 3, 4, 5, 6]
    assert [r["predicted"] for r in listed] == sorted(YIELDS.values(), reverse=True)
    rows = scoring.recommended_rows(scoring.recommend(df, FAKE, CROPS, "Crop")).orderBy("rank").collect()
    assert [r["label"] for r in rows] == ["best"] + ["other"] * 5


def test_ties_keep_the_vocabulary_order(spark):
    listed = scoring.recommend(requests(spark, CONTEXT).drop("Crop"), NEGATIVE, CROPS, "Crop").first()["recommendations"]
    assert [r["Crop"] for r in listed] == CROPS and {r["predicted"] for r in listed} == {0.0}


def test_stream_scores_rejects_and_resumes(spark, tmp_path):
    base = str(tmp_path)
    good = [{**CONTEXT, "Crop": c} for c in CROPS]
    bad = [{**CONTEXT, "Crop": "Unicorn"}, {"Region": "West"}]

    def arrive(records):
        spark.createDataFrame([(json.dumps(r),) for r in records], "value string").write.mode("append").text(f"{base}/in")

    def run(mode):
        texts = scoring_stream.read_stream(spark, f"{base}/in", "value string", "text", files_per_batch=1)
        stream = scoring_stream.parse_requests(texts, CONTRACT)
        query = scoring_stream.score_stream(
            stream, FAKE, CONTRACT, f"{base}/{mode}", f"{base}/{mode}-rejected", f"{base}/{mode}-state", mode, CROPS, "Crop"
        )
        query.awaitTermination()

    arrive(good)
    run("predict")
    arrive(bad)
    run("predict")  # continues behind the first files
    scored = spark.read.parquet(f"{base}/predict")
    assert {r["Crop"]: r["predicted"] for r in scored.collect()} == YIELDS and scored.count() == 6
    rejected = spark.read.parquet(f"{base}/predict-rejected")
    assert rejected.count() == 2 and rejected.where(F.array_contains("reasons", "Crop:unknown value")).count() == 1
    run("recommend")
    listed = spark.read.parquet(f"{base}/recommend")
    # the unknown crop is no obstacle when every crop is simulated
    assert listed.count() == 7 and {r["recommendations"][0]["Crop"] for r in listed.collect()} == {"Rice"}
