"""Registered queries: sampling, splitting, correlation, tests and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilth.catalog.registry import CLEAN, PANEL, PARCELS, query
from tilth.functions.columns import safe_corr, seeded_hash
from tilth.operators import aggregates, clean, sampling, stats
from tilth.operators.joins import enrich_left
from tilth.session import staged
from tilth.sources import views
from tilth.sources.views import BOOLEANS, NUMERICS, PARCEL_KEY, TARGET

KEY_SQL = "l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || price_cents || '|42'"
KEYS = ", ".join(PARCEL_KEY)


@query(
    "sample_n",
    "K1",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey || '|42'), o_orderkey LIMIT 500",
)
def sample_n(spark, sf_dir):
    return sampling.sample_n(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 500, ["o_orderkey"])


@query(
    "sample_tied_keys",
    "K1",
    "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem ORDER BY md5(l_suppkey || '|42'), "
    """md5('{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_suppkey":' || l_suppkey || '}') LIMIT 2000""",
)
def sample_tied_keys(spark, sf_dir):
    """Many rows share a key; which of them are taken follows from all their columns."""
    df = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return sampling.sample_n(df, 2000, ["l_suppkey"])


@query(
    "stratified_sample",
    "K2",
    f"WITH {CLEAN} SELECT {KEYS}, crop FROM clean QUALIFY row_number() OVER (PARTITION BY crop ORDER BY md5({KEY_SQL})) "
    "<= 3000 // (SELECT count(DISTINCT crop) FROM clean)",
)
def stratified_sample(spark, sf_dir):
    df = views.saved_parcels(spark, sf_dir, [*PARCEL_KEY, "crop"])
    return sampling.stratified_sample(df, ["crop"], 3000, PARCEL_KEY)


def _split_sql(source, stratum, key, names):
    """Two rounds of largest-remainder shares, then positions in hash order."""
    return f"""
, ranked AS (SELECT {names}, {stratum} AS g, row_number() OVER (PARTITION BY {stratum} ORDER BY md5({key})) AS rn FROM {source})
, sizes AS (SELECT g, count(*) AS n FROM ranked GROUP BY g)
, tot AS (SELECT sum(n) AS n, sum(n) - ceil(sum(n) * 0.15)::HUGEINT AS rest FROM sizes)
, r1 AS (SELECT g, s.n, (s.n::HUGEINT * rest) // t.n AS base, (s.n::HUGEINT * rest) % t.n AS left_over, rest FROM sizes s, tot t)
, kept AS (SELECT g, n, rest, base + CASE WHEN row_number() OVER (ORDER BY left_over DESC, g) <= rest - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM r1)
, r2 AS (SELECT g, n, k, rest - ceil(rest * 0.1765)::HUGEINT AS tr, rest,
   (k * (rest - ceil(rest * 0.1765)::HUGEINT)) // rest AS base, (k * (rest - ceil(rest * 0.1765)::HUGEINT)) % rest AS left_over FROM kept)
, fin AS (SELECT g, n - k AS c1, n - (base + CASE WHEN row_number() OVER (ORDER BY left_over DESC, g) <= tr - sum(base) OVER () THEN 1 ELSE 0 END) AS c2 FROM r2)
, split AS (SELECT ranked.*, CASE WHEN rn <= c1 THEN 'test' WHEN rn <= c2 THEN 'val' ELSE 'train' END AS split FROM ranked JOIN fin USING (g))
"""


@query(
    "stratified_split",
    "K3",
    f"WITH {CLEAN} {_split_sql('clean', 'crop', KEY_SQL, KEYS)} SELECT {KEYS}, g AS crop, split FROM split",
)
def stratified_split(spark, sf_dir):
    df = views.saved_parcels(spark, sf_dir, [*PARCEL_KEY, "crop"])
    return sampling.stratified_split(df, ["crop"], PARCEL_KEY)


@query(
    "random_split",
    "K4",
    "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(o_orderkey || '|42')) <= ceil(0.2 * count(*) OVER ()) "
    "THEN 'test' ELSE 'train' END AS split FROM orders",
)
def random_split(spark, sf_dir):
    return sampling.random_split(views.table(spark, sf_dir, "orders").select("o_orderkey"), 0.2, ["o_orderkey"])


@query(
    "random_split_by_threshold",
    "K4",
    "SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(o_orderkey || '|42'), 1, 8))::BIGINT < 0.2 * 4294967296 "
    "THEN 'test' ELSE 'train' END AS split FROM orders",
)
def random_split_by_threshold(spark, sf_dir):
    df = views.table(spark, sf_dir, "orders").select("o_orderkey")
    return sampling.random_split(df, 0.2, ["o_orderkey"], exact=False)


@query(
    "assign_folds",
    "K5",
    f"WITH {PARCELS} SELECT {KEYS}, CAST(('0x' || substr(md5({KEY_SQL}), 1, 8))::BIGINT % 5 AS INT) AS fold FROM parcels",
)
def assign_folds(spark, sf_dir):
    return sampling.assign_folds(views.parcels(spark, sf_dir).select(*PARCEL_KEY), 5, PARCEL_KEY)


@query(
    "assign_folds_exact",
    "K5",
    "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '|42')) - 1 AS i, count(*) OVER () AS n FROM orders) "
    "SELECT o_orderkey, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) "
    "ELSE (i - (n % 5) * (n // 5 + 1)) // (n // 5) + n % 5 END AS INT) AS fold FROM r",
)
def assign_folds_exact(spark, sf_dir):
    df = views.table(spark, sf_dir, "orders").select("o_orderkey")
    return sampling.assign_folds(df, 5, ["o_orderkey"], exact=True)


@query(
    "split_balance",
    "K6",
    f"WITH {CLEAN} {_split_sql('clean', 'crop', KEY_SQL, KEYS)} SELECT split, g AS crop, count(*) AS count, "
    "round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share FROM split GROUP BY split, g",
)
def split_balance(spark, sf_dir):
    df = views.saved_parcels(spark, sf_dir, [*PARCEL_KEY, "crop"])
    parts = staged(sampling.stratified_split(df, ["crop"], PARCEL_KEY).select("split", "crop"), "split")
    return clean.round_columns(aggregates.value_counts(parts, "crop", ["split"]), {"share": 6})


@query(
    "sample_with_copies",
    "K1",
    f"WITH {PANEL} SELECT count(*) AS rows, 20000 <= (SELECT count(*) FROM temp_raw) AS enough FROM "
    "(SELECT * FROM temp_raw LIMIT 20000)",
)
def sample_with_copies(spark, sf_dir):
    """A sample of exactly n rows from a table in which most rows are exact copies."""
    df = staged(views.temp_raw(spark, sf_dir), "temperatures")
    drawn = sampling.sample_n(df, 20_000, ["country", "yr", "avg_temp"])
    enough = df.agg(F.count(F.lit(1)) >= 20_000).scalar()
    return drawn.agg(F.count(F.lit(1)).alias("rows")).withColumn("enough", enough)


# ---- correlation, scaling, tests ----------------------------------------------------

NUM = {c: (f"CAST({c} AS INT)" if c in BOOLEANS else c) for c in [*BOOLEANS, *NUMERICS, TARGET]}


def _corr_sql(source, exprs, by, digits):
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {key}'{a}' AS x, '{b}' AS y, round(CASE WHEN isnan(corr({ea}, {eb})) THEN NULL ELSE corr({ea}, {eb}) END, {digits}) AS r "
        f"FROM {source}{group}"
        for a, ea in exprs.items()
        for b, eb in exprs.items()
    )


@query("corr_matrix", "M1", f"WITH {CLEAN} " + _corr_sql("clean", NUM, "", 6))
def corr_matrix(spark, sf_dir):
    return stats.corr_matrix(views.saved_parcels(spark, sf_dir), list(NUM), digits=6)


PANEL_NUM = {c: c for c in ("hg_ha_yield", "rain_mm", "avg_temp", "pesticides_t")}


HOLED_SQL = (
    "WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings), "
    "h AS (SELECT vec_id, i, CAST(v AS DOUBLE) AS v FROM e WHERE (vec_id + i * i) % 7 <> 0) "
    "SELECT 'e' || a.i AS x, 'e' || b.i AS y, round(corr(a.v, b.v), 6) AS r FROM h a JOIN h b USING (vec_id) GROUP BY a.i, b.i"
)


@query("corr_matrix_wide", "M1", HOLED_SQL)
def corr_matrix_wide(spark, sf_dir):
    """64 columns, the components of the vectors, of which a seventh of the values is missing."""
    df = views.table(spark, sf_dir, "embeddings")
    cells = [F.when((F.col("vec_id") + i * i) % 7 != 0, F.col("embedding")[i].cast("double")).alias(f"e{i}") for i in range(64)]
    return stats.corr_matrix(df.select(*cells), [f"e{i}" for i in range(64)], digits=6)


@query("corr_matrix_panel", "M1", f"WITH {PANEL} " + _corr_sql("panel", PANEL_NUM, "", 6))
def corr_matrix_panel(spark, sf_dir):
    return stats.corr_matrix(views.saved_panel(spark, sf_dir), list(PANEL_NUM), digits=6)


CROP_NUM = {c: c for c in ("rainfall_mm", "temperature_c", "yield_t")}


@query("corr_by_crop", "M2", f"WITH {CLEAN} " + _corr_sql("clean", CROP_NUM, "crop", 3))
def corr_by_crop(spark, sf_dir):
    return stats.corr_matrix(views.saved_parcels(spark, sf_dir, ["crop", *CROP_NUM]), list(CROP_NUM), by=["crop"], digits=3)


@query(
    "corr_with_yield_by_item",
    "M2",
    f"WITH {PANEL} "
    + " UNION ALL ".join(
        f"SELECT item, '{c}' AS x, round(corr({c}, hg_ha_yield), 6) AS r FROM panel GROUP BY item" for c in PANEL_NUM
    ),
)
def corr_with_yield_by_item(spark, sf_dir):
    df = stats.corr_with_target(views.panel(spark, sf_dir), list(PANEL_NUM), "hg_ha_yield", ["item"])
    return clean.round_columns(df, {"r": 6})


@query(
    "safe_corr_constant",
    "M3",
    f"WITH {CLEAN}, e AS (SELECT crop, yield_t, rainfall_mm, avg(rainfall_mm) OVER (PARTITION BY crop) AS ref FROM clean) "
    "SELECT crop, CAST(NULL AS DOUBLE) AS r_constant, round(corr(rainfall_mm, yield_t), 6) AS r FROM e GROUP BY crop",
)
def safe_corr_constant(spark, sf_dir):
    """A profile column is constant within its crop; its correlation there is NULL."""
    df = views.saved_parcels(spark, sf_dir)
    ref = df.groupBy("crop").agg(F.round(F.avg("rainfall_mm")).alias("ref"))
    return enrich_left(df, ref, "crop").groupBy("crop").agg(
        safe_corr(F.col("ref"), F.col(TARGET)).alias("r_constant"),
        F.round(safe_corr(F.col("rainfall_mm"), F.col(TARGET)), 6).alias("r"),
    )


@query(
    "standardize",
    "M4",
    f"WITH {CLEAN} SELECT {KEYS}, round((rainfall_mm - avg(rainfall_mm) OVER ()) / stddev_pop(rainfall_mm) OVER (), 5) AS rainfall_mm, "
    "round((days_to_harvest - avg(days_to_harvest) OVER ()) / stddev_pop(days_to_harvest) OVER (), 5) AS days_to_harvest FROM clean",
)
def standardize(spark, sf_dir):
    df = views.saved_parcels(spark, sf_dir, [*PARCEL_KEY, "rainfall_mm", "days_to_harvest"])
    return clean.round_columns(
        stats.standardize(df, ["rainfall_mm", "days_to_harvest"]), {"rainfall_mm": 5, "days_to_harvest": 5}
    )


@query(
    "standardize_check",
    "M4",
    "SELECT * FROM (VALUES ('rainfall_mm'), ('temperature_c'), ('days_to_harvest')) t(column_name), (SELECT 0.0::DOUBLE AS mean, 1.0::DOUBLE AS std)",
)
def standardize_check(spark, sf_dir):
    """Centred and reduced: mean 0 and population deviation 1 in every column."""
    df = stats.standardize(views.saved_parcels(spark, sf_dir), NUMERICS)
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            (F.round(F.avg(c), 6) + 0.0).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std"),
        )
        for c in NUMERICS
    ]
    return df.agg(F.array(*cells).alias("m")).select(F.inline("m")).withColumn("mean", F.abs("mean"))


@query(
    "paired_ttest",
    "M8",
    f"WITH {CLEAN}, f AS (SELECT CAST(('0x' || substr(md5({KEY_SQL}), 1, 8))::BIGINT % 5 AS INT) AS fold, * FROM clean), "
    "s AS (SELECT fold, corr(rainfall_mm, yield_t) AS a, corr(temperature_c, yield_t) AS b FROM f GROUP BY fold), "
    "t AS (SELECT count(*) AS pairs, avg(a - b) AS d, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t FROM s), "
    "v AS (SELECT *, t / sqrt(1 + t * t / 4) AS u, (t * t) / (1 + t * t / 4) AS w FROM t) "
    "SELECT pairs, round(d, 6) AS difference, round(t, 3) AS t, round(2 * (1 - (0.5 + 0.375 * abs(u) * (1 - w / 12))), 6) AS p, true AS significant FROM v",
)
def paired_ttest(spark, sf_dir):
    """Fold scores of two features (their correlations with yield) compared."""
    folds = sampling.assign_folds(views.clean_parcels(spark, sf_dir), 5, PARCEL_KEY)
    y = F.col(TARGET)
    scores = folds.groupBy("fold").agg(
        safe_corr(F.col("rainfall_mm"), y).alias("a"), safe_corr(F.col("temperature_c"), y).alias("b")
    )
    return clean.round_columns(stats.paired_ttest(scores, "a", "b"), {"difference": 6, "t": 3, "p": 6})


def _fold_summary(spark, sf_dir, sample):
    folds = sampling.assign_folds(views.clean_parcels(spark, sf_dir), 5, PARCEL_KEY)
    per_fold = folds.groupBy("crop", "fold").agg(F.avg(TARGET).alias("score"))
    df = stats.fold_summary(per_fold, ["score"], ["crop"], sample=sample)
    return clean.round_columns(df, {"mean_score": 6, "std_score": 6})


def _fold_summary_sql(fn):
    return (
        f"WITH {CLEAN}, f AS (SELECT ('0x' || substr(md5({KEY_SQL}), 1, 8))::BIGINT % 5 AS fold, crop, yield_t FROM clean), "
        "s AS (SELECT crop, fold, avg(yield_t) AS score FROM f GROUP BY crop, fold) "
        f"SELECT crop, round(avg(score), 6) AS mean_score, round({fn}(score), 6) AS std_score FROM s GROUP BY crop"
    )


@query("fold_summary_sample", "M9", _fold_summary_sql("stddev_samp"))
def fold_summary_sample(spark, sf_dir):
    return _fold_summary(spark, sf_dir, True)


@query("fold_summary_population", "M9", _fold_summary_sql("stddev_pop"))
def fold_summary_population(spark, sf_dir):
    return _fold_summary(spark, sf_dir, False)


@query(
    "regression_metrics",
    "M10",
    f"WITH {CLEAN}, e AS (SELECT region, yield_t AS y, 0.005 * rainfall_mm + 0.9 AS p FROM clean) "
    "SELECT region, count(*) AS rows, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, "
    "round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM e GROUP BY region",
)
def regression_metrics(spark, sf_dir):
    df = views.clean_parcels(spark, sf_dir).withColumn("guess", 0.005 * F.col("rainfall_mm") + 0.9)
    out = stats.regression_metrics(df, TARGET, "guess", ["region"])
    return clean.round_columns(out, {"r2": 6, "mae": 6, "rmse": 6})


@query(
    "overfit_gap",
    "M11",
    f"WITH {CLEAN}, f AS (SELECT ('0x' || substr(md5({KEY_SQL}), 1, 8))::BIGINT % 5 AS fold, crop, yield_t AS y FROM clean), "
    "k AS (SELECT unnest(range(5)) AS fold), "
    "m AS (SELECT k.fold, f.crop, avg(y) AS p FROM f, k WHERE f.fold <> k.fold GROUP BY k.fold, f.crop), "
    "e AS (SELECT m.fold, f.fold = m.fold AS held, y, p FROM f JOIN m USING (crop)), "
    "s AS (SELECT fold, held, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY fold, held) "
    "SELECT CAST(a.fold AS INT) AS fold, round(a.r2, 6) AS train_r2, round(b.r2, 6) AS val_r2, round(a.r2 - b.r2, 6) AS overfit_gap_r2 "
    "FROM s a JOIN s b ON a.fold = b.fold AND NOT a.held AND b.held",
)
def overfit_gap(spark, sf_dir):
    """A model that answers with the mean yield of the crop, over five folds."""
    k = 5
    folds = staged(sampling.assign_folds(views.clean_parcels(spark, sf_dir), k, PARCEL_KEY).select("fold", "crop", TARGET), "folds")
    # means of the other folds = totals minus the fold's own, all from one aggregate
    per = folds.groupBy("crop", "fold").agg(F.sum(TARGET).alias("s"), F.count(F.lit(1)).alias("n"))
    total = per.groupBy("crop").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    model = per.join(total, "crop").select(
        "crop", F.col("fold").alias("model"), ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("p")
    )
    every = folds.withColumn("model", F.explode(F.array(*[F.lit(i) for i in range(k)])))
    scored = enrich_left(every, model, ["crop", "model"]).withColumn("held", F.col("fold") == F.col("model"))
    m = stats.regression_metrics(scored, TARGET, "p", ["model", "held"])
    wide = m.groupBy(F.col("model").alias("fold")).agg(
        F.max(F.when(~F.col("held"), F.col("r2"))).alias("train_r2"),
        F.max(F.when(F.col("held"), F.col("r2"))).alias("val_r2"),
    )
    return clean.round_columns(stats.overfit_gap(wide), {"train_r2": 6, "val_r2": 6, "overfit_gap_r2": 6})


@query(
    "seeded_hash",
    "K1 K5",
    "SELECT user_id, event_id, md5(user_id || '|' || event_id || '|7') AS digest FROM events",
)
def seeded_hash_events(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(
        "user_id", "event_id", seeded_hash(["user_id", "event_id"], 7).alias("digest")
    )
