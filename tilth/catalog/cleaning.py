"""Registered queries: sources, cleaning, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilth.catalog.registry import CLEAN, CROP_MAP, PANEL, PARCELS, query
from tilth.functions.columns import clamp_lower, label_if
from tilth.operators import clean, joins
from tilth.session import fresh_path
from tilth.sources import reports, tables, views
from tilth.sources.views import CROP_TO_ITEM, TARGET

PARCEL_CSV = "crop string, region string, fertilizer_used boolean, days_to_harvest int, price_cents bigint"


@query(
    "read_csv_table",
    "S1 S2",
    f"WITH {PARCELS} SELECT crop, region, fertilizer_used, count(*) AS n, CAST(sum(days_to_harvest) AS BIGINT) AS days, "
    "CAST(sum(price_cents) AS BIGINT) AS cents FROM parcels GROUP BY ALL",
)
def read_csv_table(spark, sf_dir):
    path = fresh_path(spark, "parcels-csv")
    names = ["crop", "region", "fertilizer_used", "days_to_harvest", "price_cents"]
    tables.write_table(views.parcels(spark, sf_dir), path, names, fmt="csv")
    df = tables.read_table(spark, path, PARCEL_CSV, required=["crop", "region"], fmt="csv")
    return df.groupBy("crop", "region", "fertilizer_used").agg(
        F.count(F.lit(1)).alias("n"), F.sum("days_to_harvest").alias("days"), F.sum("price_cents").alias("cents")
    )


@query(
    "read_parquet_table",
    "S1",
    "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment",
)
def read_parquet_table(spark, sf_dir):
    df = tables.read_table(spark, f"{sf_dir}/customer.parquet", required=["c_custkey", "c_mktsegment"])
    return df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "write_partitioned_table",
    "S2",
    f"WITH {PANEL} SELECT yr, item, round(sum(hg_ha_yield), 2) AS total FROM panel GROUP BY yr, item",
)
def write_partitioned_table(spark, sf_dir):
    path = fresh_path(spark, "panel-by-year")
    tables.write_table(views.panel(spark, sf_dir), path, ["area", "item", "yr", "hg_ha_yield"], partition_by=["yr"])
    back = tables.read_table(spark, path)
    return back.groupBy("yr", "item").agg(F.round(F.sum("hg_ha_yield"), 2).alias("total"))


@query(
    "write_json_report",
    "S3",
    f"WITH {PARCELS} SELECT region, weather, count(*) AS n FROM parcels GROUP BY region, weather",
)
def write_json_report(spark, sf_dir):
    path = fresh_path(spark, "report")
    nested = (
        views.parcels(spark, sf_dir)
        .groupBy("region", "weather")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("region")
        .agg(F.collect_list(F.struct("weather", "n")).alias("levels"))
    )
    reports.write_document(nested, path)
    shape = "region string, levels array<struct<weather: string, n: bigint>>"
    return spark.read.text(path).select(F.from_json("value", shape).alias("d")).select(
        "d.region", F.inline("d.levels")
    )


@query(
    "rename_columns",
    "P1",
    f"WITH {PANEL} SELECT area AS country, yr AS year, rain_mm AS rainfall FROM rain_raw",
)
def rename_columns(spark, sf_dir):
    return clean.rename_columns(
        views.rain_raw(spark, sf_dir), {" area": "country", "yr": "year", "rain_mm": "rainfall"}
    )


@query(
    "drop_columns",
    "P2",
    "SELECT s_suppkey, s_nationkey FROM supplier",
)
def drop_columns(spark, sf_dir):
    return clean.drop_columns(views.table(spark, sf_dir, "supplier"), ["s_name", "s_acctbal", "s_name"])


@query(
    "select_columns",
    "P3",
    f"WITH {PARCELS} SELECT region, soil_type, crop, price_cents FROM parcels",
)
def select_columns(spark, sf_dir):
    return clean.select_columns(views.parcels(spark, sf_dir), ["region", "soil_type", "crop", "price_cents"])


@query(
    "filter_valid_yield",
    "P4",
    f"WITH {CLEAN} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price_cents, round(yield_t, 9) AS yield_t FROM clean",
)
def filter_valid_yield(spark, sf_dir):
    df = clean.filter_valid(views.parcels(spark, sf_dir), TARGET, 0.0)
    return df.select(*views.PARCEL_KEY, F.round(TARGET, 9).alias(TARGET))


@query(
    "filter_valid_balance",
    "P4",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0",
)
def filter_valid_balance(spark, sf_dir):
    return clean.filter_valid(views.table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


@query(
    "drop_missing",
    "P5",
    f"WITH {PANEL} SELECT area, yr, CAST(rain_mm AS DOUBLE) AS rain_mm FROM rain_raw WHERE rain_mm <> '..'",
)
def drop_missing(spark, sf_dir):
    rain = clean.rename_columns(views.rain_raw(spark, sf_dir), {" area": "area"})
    return clean.drop_missing(clean.coerce_numeric(rain, "rain_mm"), ["rain_mm"])


@query(
    "coerce_numeric",
    "P6",
    f"WITH {PANEL} SELECT area, yr, TRY_CAST(rain_mm AS DOUBLE) AS rain_mm FROM rain_raw",
)
def coerce_numeric(spark, sf_dir):
    rain = clean.rename_columns(views.rain_raw(spark, sf_dir), {" area": "area"})
    return clean.coerce_numeric(rain, "rain_mm")


@query("drop_exact_duplicates", "P7", f"WITH {PANEL} SELECT DISTINCT country, yr, avg_temp FROM temp_raw")
def drop_exact_duplicates(spark, sf_dir):
    return clean.drop_exact_duplicates(views.temp_raw(spark, sf_dir))


@query(
    "count_duplicates",
    "P8",
    f"WITH {PANEL} SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows "
    "FROM (SELECT count(*) AS n FROM temp_raw GROUP BY country, yr, avg_temp)",
)
def count_duplicates(spark, sf_dir):
    return clean.count_duplicates(views.temp_raw(spark, sf_dir))


@query(
    "list_duplicates",
    "P9",
    f"WITH {PANEL} SELECT country, yr, avg_temp FROM temp_raw "
    "QUALIFY count(*) OVER (PARTITION BY country, yr, avg_temp) > 1",
)
def list_duplicates(spark, sf_dir):
    return clean.list_duplicates(views.temp_raw(spark, sf_dir))


@query(
    "first_duplicates",
    "P9",
    f"WITH {PANEL} SELECT country, yr, avg_temp FROM (SELECT *, count(*) OVER (PARTITION BY country, yr, avg_temp) AS n "
    "FROM temp_raw) WHERE n > 1 ORDER BY country, yr, avg_temp LIMIT 20",
)
def first_duplicates(spark, sf_dir):
    return clean.list_duplicates(views.temp_raw(spark, sf_dir), ["country", "yr"], n=20)


@query(
    "missing_profile",
    "P10",
    f"WITH {PARCELS}, {CROP_MAP}, m AS (SELECT p.region, p.crop, c.item FROM parcels p JOIN crop_map c USING (crop)) "
    "SELECT 'region' AS column_name, count(*) FILTER (region IS NULL) AS missing FROM m UNION ALL "
    "SELECT 'crop', count(*) FILTER (crop IS NULL) FROM m UNION ALL SELECT 'item', count(*) FILTER (item IS NULL) FROM m",
)
def missing_profile(spark, sf_dir):
    mapped = clean.map_values(views.parcels(spark, sf_dir), "crop", CROP_TO_ITEM, "item")
    return clean.missing_profile(mapped.select("region", "crop", "item"))


@query(
    "scale_unit",
    "P11",
    f"WITH {PANEL} SELECT area, item, yr, avg_temp, round(hg_ha_yield / 10000, 6) AS t_ha FROM panel",
)
def scale_unit(spark, sf_dir):
    df = clean.scale_unit(views.panel(spark, sf_dir), "hg_ha_yield", 10_000, "t_ha")
    return df.select("area", "item", "yr", "avg_temp", F.round("t_ha", 6).alias("t_ha"))


@query(
    "map_values",
    "P12",
    f"WITH {PARCELS}, {CROP_MAP} SELECT crop, item, count(*) AS n FROM parcels JOIN crop_map USING (crop) GROUP BY crop, item",
)
def map_values(spark, sf_dir):
    df = clean.map_values(views.parcels(spark, sf_dir), "crop", CROP_TO_ITEM, "item")
    return df.groupBy("crop", "item").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cast_columns",
    "P13",
    f"WITH {PARCELS} SELECT l_orderkey, l_linenumber, price_cents, CAST(fertilizer_used AS INT) AS fertilizer_used, "
    "CAST(irrigation_used AS VARCHAR) AS irrigation_used, CAST(days_to_harvest AS DOUBLE) AS days_to_harvest FROM parcels",
)
def cast_columns(spark, sf_dir):
    df = views.parcels(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "price_cents", "fertilizer_used", "irrigation_used", "days_to_harvest"
    )
    return clean.cast_columns(
        df, {"fertilizer_used": "int", "irrigation_used": "string", "days_to_harvest": "double"}
    )


@query(
    "filter_in",
    "P14",
    f"WITH {PARCELS} SELECT crop, region, count(*) AS n FROM parcels WHERE crop IN ('ECONOMY', 'MEDIUM') GROUP BY crop, region",
)
def filter_in(spark, sf_dir):
    df = clean.filter_in(views.parcels(spark, sf_dir), "crop", ["ECONOMY", "MEDIUM"])
    return df.groupBy("crop", "region").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_not_in",
    "P14",
    f"WITH {PARCELS} SELECT crop, region, count(*) AS n FROM parcels WHERE crop NOT IN ('ECONOMY', 'MEDIUM') GROUP BY crop, region",
)
def filter_not_in(spark, sf_dir):
    df = clean.filter_in(views.parcels(spark, sf_dir), "crop", ["ECONOMY", "MEDIUM"], negate=True)
    return df.groupBy("crop", "region").agg(F.count(F.lit(1)).alias("n"))


@query("filter_contains", "P14", "SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'AR')")
def filter_contains(spark, sf_dir):
    return clean.filter_contains(views.table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "AR")


@query("clamp_lower", "P15", "SELECT c_custkey, greatest(0.0::DOUBLE, c_acctbal) AS shown FROM customer")
def clamp_at_zero(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select("c_custkey", clamp_lower(F.col("c_acctbal")).alias("shown"))


@query(
    "round_columns",
    "P16",
    f"WITH {PARCELS} SELECT l_orderkey, l_linenumber, price_cents, round(rainfall_mm + 0.0000001, 2) AS rainfall_mm, "
    "round(yield_t + 0.0000000001, 3) AS yield_t FROM parcels",
)
def round_columns(spark, sf_dir):
    df = views.parcels(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "price_cents",
        (F.col("rainfall_mm") + 1e-7).alias("rainfall_mm"), (F.col("yield_t") + 1e-10).alias("yield_t"),
    )
    return clean.round_columns(df, {"rainfall_mm": 2, "yield_t": 3})


@query(
    "label_if",
    "P17",
    "SELECT p_partkey, CASE WHEN p_size >= 25 THEN 'large' ELSE 'other' END AS label FROM part",
)
def label_sizes(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select(
        "p_partkey", label_if(F.col("p_size") >= 25, "large", "other").alias("label")
    )


@query("preview_first", "P18", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def preview_first(spark, sf_dir):
    return clean.preview(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 10, ["o_orderkey"])


@query("preview_last", "P18", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def preview_last(spark, sf_dir):
    df = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return clean.preview(df, 10, ["o_orderkey"], last=True)


@query(
    "schema_profile",
    "P18",
    "SELECT * FROM (VALUES (0, 'c_custkey', 'bigint'), (1, 'c_name', 'string'), (2, 'c_nationkey', 'int'), "
    "(3, 'c_acctbal', 'double'), (4, 'c_mktsegment', 'string')) t(position, column_name, data_type), "
    "(SELECT count(*) AS non_missing, count(*) AS total_rows FROM customer)",
)
def schema_profile(spark, sf_dir):
    return clean.schema_profile(views.table(spark, sf_dir, "customer"))


# ---- joins and set operations -------------------------------------------------------


@query(
    "join_sources",
    "J1 J2",
    f"WITH {PANEL} SELECT area, item, yr, round(hg_ha_yield, 2) AS hg_ha_yield, rain_mm, pesticides_t, avg_temp FROM panel",
)
def join_sources(spark, sf_dir):
    return views.panel(spark, sf_dir).withColumn("hg_ha_yield", F.round("hg_ha_yield", 2))


@query(
    "fanout_report",
    "J2",
    f"WITH {PANEL}, t AS (SELECT DISTINCT country AS area, yr, avg_temp FROM temp_raw), "
    "a AS (SELECT area, yr, count(*) AS n FROM yield_raw GROUP BY area, yr), "
    "b AS (SELECT area, yr, count(*) AS m FROM t GROUP BY area, yr) "
    "SELECT count(*) AS matched_keys, max(n) AS max_left_rows, max(m) AS max_right_rows, "
    "CAST(sum(n * m) AS BIGINT) AS joined_rows FROM a JOIN b USING (area, yr)",
)
def fanout_report(spark, sf_dir):
    temp = clean.rename_columns(clean.drop_exact_duplicates(views.temp_raw(spark, sf_dir)), {"country": "area"})
    return joins.fanout_report(views.yield_raw(spark, sf_dir), temp, ["area", "yr"])


@query(
    "enrich_left",
    "J3",
    f"WITH {PARCELS}, {PANEL}, {CROP_MAP}, ref AS (SELECT item, avg(avg_temp) AS ref_avg_temp FROM panel GROUP BY item) "
    "SELECT p.l_orderkey, p.l_linenumber, p.price_cents, m.item, round(ref_avg_temp, 6) AS ref_avg_temp "
    "FROM parcels p JOIN crop_map m USING (crop) LEFT JOIN ref ON m.item = ref.item",
)
def enrich_left(spark, sf_dir):
    fact = clean.map_values(views.parcels(spark, sf_dir), "crop", CROP_TO_ITEM, "item")
    profile = views.panel(spark, sf_dir).groupBy("item").agg(F.avg("avg_temp").alias("ref_avg_temp"))
    return joins.enrich_left(fact, profile, "item").select(
        "l_orderkey", "l_linenumber", "price_cents", "item", F.round("ref_avg_temp", 6).alias("ref_avg_temp")
    )


@query(
    "unmatched_keys",
    "J4",
    f"WITH {PARCELS}, {CROP_MAP} SELECT DISTINCT crop FROM parcels WHERE crop NOT IN (SELECT item FROM crop_map WHERE item IS NOT NULL)",
)
def unmatched_keys(spark, sf_dir):
    df = views.parcels(spark, sf_dir)
    mapped = clean.map_values(df, "crop", CROP_TO_ITEM).where(F.col("crop").isNotNull())
    return joins.unmatched_keys(df, mapped, "crop")


@query(
    "matched_rows",
    "J5",
    f"WITH {PANEL}, {PARCELS} SELECT area, item, yr, avg_temp FROM panel "
    "WHERE item IN (SELECT crop FROM parcels WHERE crop NOT IN ('ECONOMY', 'MEDIUM'))",
)
def matched_rows(spark, sf_dir):
    crops = clean.map_values(views.parcels(spark, sf_dir), "crop", CROP_TO_ITEM, "item").where(F.col("item").isNotNull())
    return joins.matched_rows(views.panel(spark, sf_dir), crops, "item").select("area", "item", "yr", "avg_temp")


@query(
    "expand_candidates",
    "J6",
    f"WITH {PARCELS}, v AS (SELECT unnest(['STANDARD','SMALL','LARGE','PROMO','ECONOMY','MEDIUM']) AS crop) "
    "SELECT p.region, v.crop, count(*) AS n, CAST(sum(p.price_cents) AS BIGINT) AS cents FROM parcels p, v GROUP BY p.region, v.crop",
)
def expand_candidates(spark, sf_dir):
    every = joins.expand_candidates(views.parcels(spark, sf_dir), list(CROP_TO_ITEM), "crop")
    return every.groupBy("region", "crop").agg(F.count(F.lit(1)).alias("n"), F.sum("price_cents").alias("cents"))


@query(
    "coverage_overall",
    "J7",
    f"WITH {PARCELS}, {CROP_MAP} SELECT count(*) AS rows, round(count(item) / count(*), 6) AS coverage "
    "FROM parcels JOIN crop_map USING (crop)",
)
def coverage_overall(spark, sf_dir):
    df = clean.map_values(views.parcels(spark, sf_dir), "crop", CROP_TO_ITEM, "item")
    return clean.round_columns(joins.coverage(df, "item"), {"coverage": 6})


@query(
    "coverage_by_crop",
    "J7",
    f"WITH {PARCELS}, {CROP_MAP} SELECT crop, count(*) AS rows, round(count(item) / count(*), 6) AS coverage "
    "FROM parcels JOIN crop_map USING (crop) GROUP BY crop",
)
def coverage_by_crop(spark, sf_dir):
    df = clean.map_values(views.parcels(spark, sf_dir), "crop", CROP_TO_ITEM, "item")
    return clean.round_columns(joins.coverage(df, "item", ["crop"]), {"coverage": 6})


@query(
    "common_values",
    "T1",
    "SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0",
)
def common_values(spark, sf_dir):
    a = views.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    b = views.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation"))
    return joins.common_values(a, b)


@query(
    "only_in_first",
    "T2",
    "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
)
def only_in_first(spark, sf_dir):
    a = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    b = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    return joins.only_in_first(a, b)


@query(
    "stack_results",
    "T3",
    f"WITH {PARCELS} SELECT 'crop' AS source, crop AS level, count(*) AS n FROM parcels GROUP BY crop UNION ALL "
    "SELECT 'region', region, count(*) FROM parcels GROUP BY region UNION ALL "
    "SELECT 'weather', weather, count(*) FROM parcels GROUP BY weather",
)
def stack_results(spark, sf_dir):
    df = views.parcels(spark, sf_dir)
    parts = [
        df.groupBy(F.lit(c).alias("source"), F.col(c).alias("level")).agg(F.count(F.lit(1)).alias("n"))
        for c in ("crop", "region", "weather")
    ]
    return joins.stack_results(parts)
