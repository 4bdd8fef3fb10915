"""Registered queries: aggregates, distributions, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilth.catalog.registry import CLEAN, CROP_MAP, PANEL, PARCELS, query
from tilth.operators import aggregates, clean, distribution, joins, ranking
from tilth.session import staged
from tilth.sources import views
from tilth.sources.views import BOOLEANS, CATEGORICALS, CROP_TO_ITEM, NUMERICS, TARGET


@query(
    "reference_profile",
    "A1",
    f"WITH {PANEL} SELECT item, round(avg(rain_mm), 6) AS ref_rainfall, round(avg(avg_temp), 6) AS ref_temp, "
    "round(avg(pesticides_t), 6) AS ref_pesticides, round(median(hg_ha_yield) / 10000, 6) AS ref_yield FROM panel GROUP BY item",
)
def reference_profile(spark, sf_dir):
    means = {"rain_mm": "ref_rainfall", "avg_temp": "ref_temp", "pesticides_t": "ref_pesticides"}
    df = aggregates.reference_profile(views.saved_panel(spark, sf_dir), "item", means, "hg_ha_yield", "ref_yield", 10_000)
    return clean.round_columns(df, {c: 6 for c in [*means.values(), "ref_yield"]})


PROFILE = {
    "rainfall_mm": "d1_rainfall", "temperature_c": "d1_temperature", "fertilizer_used": "d1_fertilizer_rate",
    "irrigation_used": "d1_irrigation_rate", "days_to_harvest": "d1_days", "yield_t": "d1_yield",
}


@query(
    "parcel_profile",
    "A2",
    f"WITH {CLEAN}, {CROP_MAP} SELECT item, round(avg(rainfall_mm), 6) AS d1_rainfall, round(avg(temperature_c), 6) AS d1_temperature, "
    "round(avg(CAST(fertilizer_used AS INT)), 6) AS d1_fertilizer_rate, round(avg(CAST(irrigation_used AS INT)), 6) AS d1_irrigation_rate, "
    "round(avg(days_to_harvest), 6) AS d1_days, round(avg(yield_t), 6) AS d1_yield "
    "FROM clean JOIN crop_map USING (crop) WHERE item IS NOT NULL GROUP BY item",
)
def parcel_profile(spark, sf_dir):
    mapped = clean.map_values(views.clean_parcels(spark, sf_dir), "crop", CROP_TO_ITEM, "item")
    return clean.round_columns(aggregates.parcel_profile(mapped, "item", PROFILE), {c: 6 for c in PROFILE.values()})


@query(
    "summarize_by_region",
    "A3",
    f"WITH {CLEAN} SELECT region, round(avg(yield_t), 6) AS mean, round(median(yield_t), 6) AS median, "
    "round(min(yield_t), 6) AS min, round(max(yield_t), 6) AS max, count(*) AS count FROM clean GROUP BY region",
)
def summarize_by_region(spark, sf_dir):
    df = aggregates.summarize(views.saved_parcels(spark, sf_dir, ["region", TARGET]), ["region"], TARGET)
    return clean.round_columns(df, {c: 6 for c in ("mean", "median", "min", "max")})


@query(
    "summarize_by_both_flags",
    "A3",
    f"WITH {CLEAN} SELECT fertilizer_used, irrigation_used, round(avg(yield_t), 6) AS mean, round(median(yield_t), 6) AS median, "
    "round(min(yield_t), 6) AS min, round(max(yield_t), 6) AS max, count(*) AS count FROM clean GROUP BY ALL",
)
def summarize_by_both_flags(spark, sf_dir):
    df = aggregates.summarize(views.saved_parcels(spark, sf_dir, [*BOOLEANS, TARGET]), BOOLEANS, TARGET)
    return clean.round_columns(df, {c: 6 for c in ("mean", "median", "min", "max")})


@query(
    "pivot_mean",
    "A4",
    f"WITH {CLEAN} SELECT soil_type, round(avg(yield_t) FILTER (weather = 'A'), 6) AS A, "
    "round(avg(yield_t) FILTER (weather = 'N'), 6) AS N, round(avg(yield_t) FILTER (weather = 'R'), 6) AS R FROM clean GROUP BY soil_type",
)
def pivot_mean(spark, sf_dir):
    df = aggregates.pivot_mean(views.clean_parcels(spark, sf_dir), "soil_type", "weather", TARGET, ["A", "N", "R"])
    return clean.round_columns(df, {"A": 6, "N": 6, "R": 6})


@query(
    "mean_by_crop",
    "A5",
    f"WITH {CLEAN} SELECT crop, round(avg(days_to_harvest), 6) AS mean_days_to_harvest, round(avg(temperature_c), 6) AS mean_temperature_c, "
    "round(avg(rainfall_mm), 6) AS mean_rainfall_mm, round(avg(yield_t), 6) AS mean_yield_t FROM clean GROUP BY crop",
)
def mean_by_crop(spark, sf_dir):
    names = ["days_to_harvest", "temperature_c", "rainfall_mm", "yield_t"]
    df = aggregates.mean_by(views.clean_parcels(spark, sf_dir), "crop", names)
    return clean.round_columns(df, {f"mean_{c}": 6 for c in names})


@query(
    "mean_by_year",
    "A5",
    f"WITH {PANEL} SELECT yr, round(avg(avg_temp), 6) AS mean_avg_temp, round(avg(rain_mm), 6) AS mean_rain_mm, "
    "round(avg(hg_ha_yield), 6) AS mean_hg_ha_yield FROM panel GROUP BY yr",
)
def mean_by_year(spark, sf_dir):
    df = aggregates.mean_by(views.panel(spark, sf_dir), "yr", ["avg_temp", "rain_mm", "hg_ha_yield"])
    return clean.round_columns(df, {"mean_avg_temp": 6, "mean_rain_mm": 6, "mean_hg_ha_yield": 6})


def _describe_sql(names, source, digits):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, count({n}) AS count, round(avg({n}), {digits}) AS mean, "
        f"round(stddev_samp({n}), {digits}) AS std, round(min(CAST({n} AS DOUBLE)), {digits}) AS min, "
        f"round(quantile_cont(CAST({n} AS DOUBLE), 0.25), {digits}) AS p25, round(quantile_cont(CAST({n} AS DOUBLE), 0.5), {digits}) AS p50, "
        f"round(quantile_cont(CAST({n} AS DOUBLE), 0.75), {digits}) AS p75, round(max(CAST({n} AS DOUBLE)), {digits}) AS max FROM {source}"
        for n in names
    )


@query("describe_parcels", "A6", f"WITH {PARCELS} " + _describe_sql([*NUMERICS, TARGET], "parcels", 5))
def describe_parcels(spark, sf_dir):
    df = aggregates.describe(staged(views.parcels(spark, sf_dir).select(*NUMERICS, TARGET), "parcels"), [*NUMERICS, TARGET])
    return clean.round_columns(df, {c: 5 for c in ("mean", "std", "min", "p25", "p50", "p75", "max")})


@query(
    "describe_panel", "A6", f"WITH {PANEL} " + _describe_sql(["rain_mm", "pesticides_t", "avg_temp", "hg_ha_yield"], "panel", 4)
)
def describe_panel(spark, sf_dir):
    df = aggregates.describe(views.saved_panel(spark, sf_dir), ["rain_mm", "pesticides_t", "avg_temp", "hg_ha_yield"])
    return clean.round_columns(df, {c: 4 for c in ("mean", "std", "min", "p25", "p50", "p75", "max")})


@query(
    "distinct_values",
    "A7",
    f"WITH {PARCELS} "
    + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS column_name, {c} AS value FROM parcels" for c in CATEGORICALS),
)
def distinct_values(spark, sf_dir):
    return aggregates.distinct_values(views.parcels(spark, sf_dir), CATEGORICALS)


UNIQUE = [*CATEGORICALS, *BOOLEANS, "temperature_c", "days_to_harvest", "price_cents"]


@query(
    "n_unique",
    "A7",
    f"WITH {PARCELS} "
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM parcels" for c in UNIQUE),
)
def n_unique(spark, sf_dir):
    return aggregates.n_unique(views.parcels(spark, sf_dir), UNIQUE)


@query(
    "value_counts_crop",
    "A8",
    f"WITH {CLEAN} SELECT crop, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM clean GROUP BY crop",
)
def value_counts_crop(spark, sf_dir):
    return clean.round_columns(aggregates.value_counts(views.saved_parcels(spark, sf_dir, ["crop"]), "crop"), {"share": 6})


@query(
    "value_counts_documents",
    "A8",
    "SELECT lang, source, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share "
    "FROM documents GROUP BY lang, source",
)
def value_counts_documents(spark, sf_dir):
    df = aggregates.value_counts(views.table(spark, sf_dir, "documents").select("lang", "source"), "source", ["lang"])
    return clean.round_columns(df, {"share": 6})


@query(
    "group_compare",
    "A9",
    f"WITH {CLEAN}, {PANEL}, {CROP_MAP}, ref AS (SELECT item, median(hg_ha_yield) / 10000 AS y FROM panel GROUP BY item) "
    "SELECT crop, round(avg(yield_t), 6) AS simulated_yield, round(avg(ref.y), 6) AS reference_yield "
    "FROM clean JOIN crop_map USING (crop) JOIN ref USING (item) GROUP BY crop",
)
def group_compare(spark, sf_dir):
    means = {"rain_mm": "ref_rainfall"}
    profile = aggregates.reference_profile(views.saved_panel(spark, sf_dir), "item", means, "hg_ha_yield", "ref_yield", 10_000)
    fact = clean.map_values(views.clean_parcels(spark, sf_dir), "crop", CROP_TO_ITEM, "item")
    merged = joins.enrich_left(fact, profile, "item")
    df = aggregates.group_compare(merged, "crop", {TARGET: "simulated_yield", "ref_yield": "reference_yield"})
    return clean.round_columns(df, {"simulated_yield": 6, "reference_yield": 6})


@query(
    "mean_with_and_without",
    "A10",
    f"WITH {CLEAN} SELECT round(avg(yield_t), 6) AS mean_all, round(avg(yield_t) FILTER (crop NOT IN ('ECONOMY', 'MEDIUM')), 6) "
    "AS mean_without, count(*) FILTER (crop IN ('ECONOMY', 'MEDIUM')) AS rows_left_out FROM clean",
)
def mean_with_and_without(spark, sf_dir):
    df = aggregates.mean_with_and_without(views.clean_parcels(spark, sf_dir), TARGET, "crop", ["ECONOMY", "MEDIUM"])
    return clean.round_columns(df, {"mean_all": 6, "mean_without": 6})


@query("group_std", "A11", f"WITH {PANEL} SELECT item, round(stddev_samp(hg_ha_yield), 4) AS std FROM panel GROUP BY item")
def group_std(spark, sf_dir):
    return clean.round_columns(aggregates.group_std(views.panel(spark, sf_dir), "item", "hg_ha_yield"), {"std": 4})


@query(
    "skewness",
    "A12",
    f"WITH {CLEAN} SELECT round(skewness(rainfall_mm), 6) AS rainfall_mm, round(skewness(yield_t), 6) AS yield_t, "
    "round(skewness(days_to_harvest), 6) AS days_to_harvest FROM clean",
)
def skewness(spark, sf_dir):
    return views.clean_parcels(spark, sf_dir).agg(
        *[F.round(aggregates.skewness(c), 6).alias(c) for c in ("rainfall_mm", "yield_t", "days_to_harvest")]
    )


@query(
    "quantile_trend",
    "A13",
    f"WITH {PANEL}, q AS (SELECT quantile_cont(pesticides_t, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS e FROM panel), "
    "edges AS (SELECT row_number() OVER (ORDER BY v) AS i, v FROM (SELECT DISTINCT unnest(e) AS v FROM q)), "
    "bins AS (SELECT a.i AS bin, a.v AS lo, b.v AS hi FROM edges a JOIN edges b ON b.i = a.i + 1) "
    "SELECT CAST(bin AS INT) AS bin, round(lo, 4) AS lo, round(hi, 4) AS hi, count(*) AS rows, round(avg(hg_ha_yield), 6) AS mean, "
    "round((lo + hi) / 2, 4) AS mid FROM panel JOIN bins ON pesticides_t <= hi AND (pesticides_t > lo OR (bin = 1 AND pesticides_t >= lo)) "
    "GROUP BY bin, lo, hi",
)
def quantile_trend(spark, sf_dir):
    df = distribution.quantile_trend(views.saved_panel(spark, sf_dir), "pesticides_t", "hg_ha_yield")
    return clean.round_columns(df, {"lo": 4, "hi": 4, "mean": 6, "mid": 4})


def _histogram_sql(source, name, bins, digits):
    return (
        f", s AS (SELECT min({name}) AS lo, max({name}) AS hi, avg({name}) AS mean, median({name}) AS med FROM {source}), "
        f"b AS (SELECT least(CAST(floor(({name} - lo) / ((hi - lo) / {bins})) AS BIGINT) + 1, {bins}) AS bin, count(*) AS n "
        f"FROM {source}, s GROUP BY 1) "
        f"SELECT g.bin, round(lo + (g.bin - 1) * ((hi - lo) / {bins}), {digits}) AS lo, "
        f"round(lo + g.bin * ((hi - lo) / {bins}), {digits}) AS hi, coalesce(n, 0) AS count, "
        f"round(mean, {digits}) AS mean, round(med, {digits}) AS median "
        f"FROM (SELECT unnest(range(1, {bins + 1})) AS bin) g LEFT JOIN b USING (bin), s"
    )


@query("histogram_yield", "A14", f"WITH {CLEAN}" + _histogram_sql("clean", "yield_t", 30, 5))
def histogram_yield(spark, sf_dir):
    df = distribution.histogram(views.saved_parcels(spark, sf_dir, [TARGET]), TARGET, 30)
    return clean.round_columns(df, {"lo": 5, "hi": 5, "mean": 5, "median": 5})


@query("histogram_panel", "A14", f"WITH {PANEL}" + _histogram_sql("panel", "hg_ha_yield", 50, 3))
def histogram_panel(spark, sf_dir):
    df = distribution.histogram(views.saved_panel(spark, sf_dir), "hg_ha_yield", 50)
    return clean.round_columns(df, {"lo": 3, "hi": 3, "mean": 3, "median": 3})


def _box_sql(source, name, by, digits):
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN q USING ({by})" if by else ", q"
    inside = f"{name} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    return (
        f", q AS (SELECT {key}quantile_cont({name}, 0.25) AS q1, quantile_cont({name}, 0.5) AS med, "
        f"quantile_cont({name}, 0.75) AS q3 FROM {source} {group}) "
        f"SELECT {key}round(q1, {digits}) AS q1, round(med, {digits}) AS median, round(q3, {digits}) AS q3, "
        f"round(min({name}) FILTER ({inside}), {digits}) AS whisker_low, "
        f"round(max({name}) FILTER ({inside}), {digits}) AS whisker_high, count(*) FILTER (NOT ({inside})) AS outliers "
        f"FROM {source} {join} GROUP BY {key}q1, med, q3"
    )


BOX_DIGITS = ("q1", "median", "q3", "whisker_low", "whisker_high")


@query("box_stats", "A15", f"WITH {CLEAN}" + _box_sql("clean", "yield_t", "", 6))
def box_stats(spark, sf_dir):
    df = distribution.box_stats(views.saved_parcels(spark, sf_dir, [TARGET]), TARGET)
    return clean.round_columns(df, {c: 6 for c in BOX_DIGITS})


@query("box_stats_by_item", "A15", f"WITH {PANEL}" + _box_sql("panel", "hg_ha_yield", "item", 3))
def box_stats_by_item(spark, sf_dir):
    df = distribution.box_stats(views.saved_panel(spark, sf_dir), "hg_ha_yield", ["item"])
    return clean.round_columns(df, {c: 3 for c in BOX_DIGITS})


@query(
    "kde_grid",
    "A16",
    f"WITH {CLEAN}, s AS (SELECT count(*) AS n, min(yield_t) AS lo, max(yield_t) - min(yield_t) AS span, "
    "stddev_samp(yield_t) * pow(count(*), -0.2) AS h FROM clean), "
    "b AS (SELECT least(CAST(floor((yield_t - lo) / (span / 1024)) AS BIGINT), 1023) AS bin, count(*) AS w FROM clean, s GROUP BY 1) "
    "SELECT point, round(lo + point * (span / 199), 6) AS x, "
    "round(sum(w * exp(-0.5 * pow((lo + point * (span / 199) - (lo + (bin + 0.5) * (span / 1024))) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density "
    "FROM b, s, (SELECT unnest(range(0, 200)) AS point) GROUP BY point, lo, span, h, n",
)
def kde_grid(spark, sf_dir):
    return clean.round_columns(distribution.kde_grid(views.saved_parcels(spark, sf_dir, [TARGET]), TARGET), {"x": 6, "density": 6})


@query(
    "kde_exact",
    "A16",
    f"WITH {PANEL}, s AS (SELECT count(*) AS n, min(pesticides_t) AS lo, max(pesticides_t) - min(pesticides_t) AS span, "
    "stddev_samp(pesticides_t) * pow(count(*), -0.2) AS h FROM panel) "
    "SELECT point, round(lo + point * (span / 199), 4) AS x, "
    "round(1000 * sum(exp(-0.5 * pow((lo + point * (span / 199) - pesticides_t) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density_per_1000 "
    "FROM panel, s, (SELECT unnest(range(0, 200)) AS point) GROUP BY point, lo, span, h, n",
)
def kde_exact(spark, sf_dir):
    df = distribution.kde_grid(views.saved_panel(spark, sf_dir), "pesticides_t", bins=None)
    return df.select("point", F.round("x", 4).alias("x"), F.round(1000 * F.col("density"), 6).alias("density_per_1000"))


def _bounds_sql(name, whole):
    def shown(p):
        q = f"quantile_cont(CAST({name} AS DOUBLE), {p})"
        return f"CAST(trunc({q}) AS DOUBLE)" if whole else f"round({q}, 1)"

    return (
        f"SELECT '{name}' AS column_name, round(min(CAST({name} AS DOUBLE)), 6) AS valid_min, round(max(CAST({name} AS DOUBLE)), 6) AS valid_max, "
        f"{shown(0.01)} AS suggested_min, {shown(0.99)} AS suggested_max, {shown(0.5)} AS suggested_default FROM clean"
    )


@query(
    "bounds_profile",
    "A17",
    f"WITH {CLEAN} " + " UNION ALL ".join(_bounds_sql(n, n == "days_to_harvest") for n in NUMERICS),
)
def bounds_profile(spark, sf_dir):
    doc = aggregates.bounds_profile(views.saved_parcels(spark, sf_dir), NUMERICS, CATEGORICALS)
    fields = ["valid_min", "valid_max", "suggested_min", "suggested_max", "suggested_default"]
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("column_name"), *[F.col(f"numeric.{n}.{f}").cast("double").alias(f) for f in fields])
            for n in NUMERICS
        ]
    )
    return clean.round_columns(doc.select(F.inline(rows)), {"valid_min": 6, "valid_max": 6})


@query(
    "bounds_vocabulary",
    "A17",
    f"WITH {CLEAN}, v AS ("
    + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS column_name, {c} AS value FROM clean" for c in CATEGORICALS)
    + ") SELECT column_name, CAST(row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS INT) AS position, value FROM v",
)
def bounds_vocabulary(spark, sf_dir):
    doc = aggregates.bounds_profile(views.saved_parcels(spark, sf_dir), ["days_to_harvest"], CATEGORICALS)
    parts = [
        doc.select(F.lit(c).alias("column_name"), F.posexplode(f"categorical.{c}").alias("position", "value"))
        for c in CATEGORICALS
    ]
    return joins.stack_results(parts)


# ---- ranking ------------------------------------------------------------------------


@query(
    "top_areas",
    "W1",
    f"WITH {PANEL} SELECT area, round(sum(hg_ha_yield), 2) AS total FROM panel GROUP BY area ORDER BY sum(hg_ha_yield) DESC, area LIMIT 20",
)
def top_areas(spark, sf_dir):
    df = ranking.top_k_groups(views.panel(spark, sf_dir), ["area"], "hg_ha_yield", 20)
    return clean.round_columns(df, {"total": 2})


@query(
    "top_area_items",
    "W1",
    f"WITH {PANEL} SELECT area, item, round(sum(hg_ha_yield), 2) AS total FROM panel GROUP BY area, item "
    "ORDER BY sum(hg_ha_yield) DESC, area, item LIMIT 10",
)
def top_area_items(spark, sf_dir):
    df = ranking.top_k_groups(views.panel(spark, sf_dir), ["area", "item"], "hg_ha_yield", 10)
    return clean.round_columns(df, {"total": 2})


@query(
    "rank_candidates",
    "W2",
    f"WITH {PANEL}, t AS (SELECT area, item, CAST(sum(round(hg_ha_yield * 100)) AS BIGINT) AS total FROM panel GROUP BY area, item) "
    "SELECT area, item, total, CAST(row_number() OVER (PARTITION BY area ORDER BY total DESC, item) AS INT) AS rank FROM t",
)
def rank_candidates(spark, sf_dir):
    total = F.sum(F.round(F.col("hg_ha_yield") * 100)).cast("bigint").alias("total")
    df = views.panel(spark, sf_dir).groupBy("area", "item").agg(total)
    return ranking.rank_candidates(df, ["area"], "total", "item")


@query(
    "cumulative_share",
    "W4",
    f"WITH {CLEAN}, c AS (SELECT days_to_harvest, count(*) / sum(count(*)) OVER () AS share FROM clean GROUP BY days_to_harvest) "
    "SELECT days_to_harvest, round(share, 6) AS share, round(sum(share) OVER (ORDER BY days_to_harvest), 6) AS cumulative FROM c",
)
def cumulative_share(spark, sf_dir):
    shares = aggregates.value_counts(views.saved_parcels(spark, sf_dir, ["days_to_harvest"]), "days_to_harvest").drop("count")
    df = ranking.cumulative_share(shares, "days_to_harvest", "share")
    return clean.round_columns(df, {"share": 6, "cumulative": 6})


@query(
    "sort_by_magnitude",
    "W5",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey",
)
def sort_by_magnitude(spark, sf_dir):
    df = views.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return ranking.sort_by_magnitude(df, "c_acctbal", ["c_custkey"])


@query(
    "without_top",
    "W6",
    "SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) > 3",
)
def without_top(spark, sf_dir):
    df = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranking.without_top(df, "o_totalprice", ["o_orderkey"], 3)


@query(
    "best_of",
    "W7",
    f"WITH {PARCELS} SELECT region, crop, round(yield_t, 9) AS yield_t, l_orderkey, l_linenumber FROM parcels "
    "QUALIFY row_number() OVER (PARTITION BY region, crop ORDER BY round(yield_t, 9) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, price_cents) = 1",
)
def best_of(spark, sf_dir):
    df = views.parcels(spark, sf_dir).select(
        "region", "crop", F.round(TARGET, 9).alias(TARGET), *views.PARCEL_KEY
    )
    best = ranking.best_of(df, ["region", "crop"], TARGET, views.PARCEL_KEY)
    return best.select("region", "crop", TARGET, "l_orderkey", "l_linenumber")
