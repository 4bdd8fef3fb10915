"""Parcel and panel tables derived from the star-schema test tables.

``parcels`` has the shape of a field-level yield table (four categories, two booleans,
three numerics, a target); the ``*_raw`` tables have the shape of four country-level
sources with text junk, duplicates and fan-out, and ``panel`` is their cleaned join.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.operators import clean, joins
from tilth.session import hash_joins, local_if_small, spread, staged

PARCEL_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_cents"]
NUMERICS = ["rainfall_mm", "temperature_c", "days_to_harvest"]
BOOLEANS = ["fertilizer_used", "irrigation_used"]
CATEGORICALS = ["region", "soil_type", "crop", "weather"]
TARGET = "yield_t"
# two of the six crops have no counterpart in the panel
CROP_TO_ITEM = {
    "STANDARD": "STANDARD",
    "SMALL": "SMALL",
    "LARGE": "LARGE",
    "PROMO": "PROMO",
    "ECONOMY": None,
    "MEDIUM": None,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    hash_joins(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table; a single small file is spread over the cores first."""
    return spread(table(spark, sf_dir, "lineitem").drop("l_tax"), "l_orderkey")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    region = table(spark, sf_dir, "region")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # the dimension chains are joined first, so the fact table meets three sides only and
    # is shuffled at most once, by the key of its largest partner
    place = _places(spark, sf_dir).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    place = local_if_small(place.select("s_suppkey", F.col("r_name").alias("region")))
    buyer = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    buyer = buyer.select("o_orderkey", F.col("c_mktsegment").alias("soil_type"))
    joined = (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(place, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(buyer, F.col("l_orderkey") == F.col("o_orderkey"))
    )
    rain = 100 + F.col("l_extendedprice") * 0.0085
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    fertilized = F.col("l_linestatus") == "F"
    irrigated = F.col("l_discount") > 0.05
    gain = (
        -1.0
        + 0.005 * rain
        + F.when(fertilized, 1.5).otherwise(0.0)
        + F.when(irrigated, 1.2).otherwise(0.0)
        + 0.02 * F.col("p_size")
        + (cents % 1000) / 500.0
        - 1.0
    )
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "region", "soil_type",
        F.col("p_type").alias("crop"), F.col("l_returnflag").alias("weather"),
        fertilized.alias("fertilizer_used"), irrigated.alias("irrigation_used"),
        rain.alias("rainfall_mm"), (15 + F.col("p_size") * 0.5).alias("temperature_c"),
        (60 + F.col("l_quantity")).cast("int").alias("days_to_harvest"),
        cents.alias("price_cents"), gain.alias("yield_t"),
    )


def clean_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.filter_valid(parcels(spark, sf_dir), TARGET, 0.0)


def saved_parcels(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """Clean parcels written once: for work that reads them several times, so that the
    joins behind them run once."""
    df = clean_parcels(spark, sf_dir)
    return staged(df.select(*names) if names else df, "parcels")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows with their area and year; the raw sources aggregate it where it is read."""
    lines = table(spark, sf_dir, "lineitem")
    place = _places(spark, sf_dir).select("s_suppkey", "n_nationkey", F.col("n_name").alias("area"))
    joined = lines.join(local_if_small(place), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.withColumn("yr", F.year("l_shipdate"))


def yield_raw(spark: SparkSession, sf_dir: str, ship: DataFrame | None = None) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("item"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return (
        (ship or shipments(spark, sf_dir))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("area", "item", "yr")
        .agg((F.sum(cents).cast("double") / 100).alias("hg_ha_yield"))
    )


def rain_raw(spark: SparkSession, sf_dir: str, ship: DataFrame | None = None) -> DataFrame:
    """One text value per area and year, some of them '..'; the area column carries the
    leading space its source has."""
    key = F.col("n_nationkey")
    value = (500 + 20 * key + F.col("yr") % 5).cast("string")
    return (
        (ship or shipments(spark, sf_dir))
        .select("area", "n_nationkey", "yr")
        .distinct()
        .select(
            F.col("area").alias(" area"), "yr",
            F.when((key + F.col("yr")) % 7 == 0, "..").otherwise(value).alias("rain_mm"),
        )
    )


def pest_raw(spark: SparkSession, sf_dir: str, ship: DataFrame | None = None) -> DataFrame:
    return (
        (ship or shipments(spark, sf_dir))
        .where(F.col("yr") >= 1997)
        .groupBy("area", "yr")
        .agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("pesticides_t"))
    )


def temp_raw(spark: SparkSession, sf_dir: str, ship: DataFrame | None = None) -> DataFrame:
    return (
        (ship or shipments(spark, sf_dir))
        .where(F.col("yr") <= 2000)
        .select(
            F.col("area").alias("country"), "yr",
            (10 + F.col("l_linenumber") % 3 + F.col("n_nationkey") * 0.5).alias("avg_temp"),
        )
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rename, coerce, drop missing, deduplicate, then three joins on (area, yr)."""
    ship = shipments(spark, sf_dir)
    rain = clean.rename_columns(rain_raw(spark, sf_dir, ship), {" area": "area"})
    rain = clean.drop_missing(clean.coerce_numeric(rain, "rain_mm"), ["rain_mm"])
    temp = clean.rename_columns(temp_raw(spark, sf_dir, ship), {"country": "area"})
    temp = clean.drop_exact_duplicates(temp)
    joined = joins.join_sources(
        yield_raw(spark, sf_dir, ship), rain, pest_raw(spark, sf_dir, ship), temp, keys=["area", "yr"]
    )
    return clean.select_columns(
        joined, ["area", "item", "yr", "hg_ha_yield", "rain_mm", "pesticides_t", "avg_temp"]
    )


def saved_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel written once, as an analysis of it reads it several times."""
    return staged(panel(spark, sf_dir), "panel")
