"""Registered queries: features, linear and tree models, evaluation, explanation, scoring."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilth.catalog.registry import CLEAN, CROP_MAP, PANEL, PARCELS, query
from tilth.catalog.statistics import KEY_SQL, KEYS, _split_sql
from tilth.operators import clean, explain, features, gram, linear, multivariate, ranking, sampling, scoring, stats, trees, wide
from tilth.functions.columns import safe_corr
from tilth.operators.gram import FeatureSpec
from tilth.operators.joins import stack_results
from tilth.operators.linear import LinearModel
from tilth.operators.validation import Contract, checked
from tilth.plans import enrichment, experiments
from tilth.session import fresh_path, staged
from tilth.sources import models, runs, views
from tilth.sources.views import BOOLEANS, CATEGORICALS, CROP_TO_ITEM, NUMERICS, PARCEL_KEY, TARGET
from tilth.streaming import scoring_stream

CROPS = list(CROP_TO_ITEM)
SPEC = FeatureSpec(tuple(NUMERICS), tuple(BOOLEANS), tuple(CATEGORICALS), TARGET, ("ref_yield",))
PAIR = FeatureSpec(numerics=("rainfall_mm", "temperature_c"), target=TARGET)

# A hand-written model for the scoring queries, so that their oracle is plain arithmetic.
MODEL = LinearModel(
    2.31416,
    {"rainfall_mm": (1.2817, 348.617, 197.313), "temperature_c": (0.28113, 27.731, 7.2171), "days_to_harvest": (-0.0173, 85.37, 14.411)},
    {"fertilizer_used": 1.49317, "irrigation_used": 1.20713},
    {
        "region": {"AFRICA": 0.01171, "AMERICA": -0.02313, "ASIA": 0.00719, "EUROPE": -0.00523, "MIDDLE EAST": 0.01337},
        "crop": {"STANDARD": 0.0717, "SMALL": -0.1319, "LARGE": 0.1123, "PROMO": 0.0331, "ECONOMY": -0.0917, "MEDIUM": 0.0193},
    },
)


def _term_sql(parent, value=None):
    v = value or parent
    if parent in MODEL.numerics:
        c, m, s = MODEL.numerics[parent]
        return f"({c}::DOUBLE * ((CAST({v} AS DOUBLE) - {m}::DOUBLE) / {s}::DOUBLE))"
    if parent in MODEL.booleans:
        return f"({MODEL.booleans[parent]}::DOUBLE * CAST({v} AS INT))"
    whens = " ".join(f"WHEN '{k}' THEN {c}::DOUBLE" for k, c in MODEL.levels[parent].items())
    return f"(CASE {v} {whens} ELSE 0.0::DOUBLE END)"


RAW_SQL = f"({MODEL.intercept}::DOUBLE + " + " + ".join(_term_sql(p) for p in MODEL.parents) + ")"


def _parcels(spark, sf_dir):
    return views.clean_parcels(spark, sf_dir)


def _saved(spark, sf_dir, names=None):
    return views.saved_parcels(spark, sf_dir, names)


def _folds(spark, sf_dir):
    """Clean parcels with folds, written once: fitting and scoring read them again."""
    folds = sampling.assign_folds(_parcels(spark, sf_dir), 5, PARCEL_KEY)
    return staged(folds.select("fold", *SPEC.columns), "folds")


# ---- features -----------------------------------------------------------------------


@query(
    "one_hot",
    "F1",
    f"WITH {CLEAN} SELECT "
    + ", ".join(f"count(*) FILTER (crop = '{c}') AS crop_{c}" for c in sorted(CROPS))
    + ", count(*) FILTER (weather = 'A') AS weather_A, count(*) FILTER (weather = 'N') AS weather_N, count(*) FILTER (weather = 'R') AS weather_R FROM clean",
)
def one_hot(spark, sf_dir):
    df = features.one_hot(_saved(spark, sf_dir).select("crop", "weather"), ["crop", "weather"])
    return df.agg(*[F.sum(c).alias(c) for c in df.columns if c not in ("crop", "weather")])


@query(
    "dummies",
    "F2",
    f"WITH {CLEAN} SELECT region, "
    + ", ".join(f"count(*) FILTER (crop = '{c}') AS crop_{c}" for c in sorted(CROPS)[1:])
    + ", count(*) FILTER (weather = 'N') AS weather_N, count(*) FILTER (weather = 'R') AS weather_R FROM clean GROUP BY region",
)
def dummies(spark, sf_dir):
    df = features.dummies(_saved(spark, sf_dir).select("region", "crop", "weather"), ["crop", "weather"])
    names = [c for c in df.columns if c != "region"]
    return df.groupBy("region").agg(*[F.sum(c).alias(c) for c in names])


@query(
    "build_features",
    "F3",
    f"WITH {CLEAN} SELECT count(*) AS rows, CAST(24 AS INT) AS width, CAST(count(*) * 4 AS BIGINT) AS ones FROM clean",
)
def build_features(spark, sf_dir):
    """Scaled numerics, raw booleans and all levels: one level per category is 1."""
    df = _saved(spark, sf_dir)
    encoded = features.build_features(df, SPEC).transform(df)
    vector = vector_to_array("features")
    levels = F.aggregate(F.slice(vector, F.lit(6), F.size(vector)), F.lit(0.0), lambda a, x: a + x)
    return encoded.agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size(vector)).alias("width"), F.sum(levels).cast("bigint").alias("ones")
    )


@query(
    "target_encode",
    "F4",
    f"WITH {CLEAN} SELECT crop, round(avg(yield_t), 6) AS encoded FROM clean GROUP BY crop",
)
def target_encode(spark, sf_dir):
    df = features.target_encode(_saved(spark, sf_dir).select("crop", TARGET), ["crop"], TARGET)
    return df.groupBy("crop").agg(F.round(F.first("crop__t"), 6).alias("encoded"))


def _ordered_sql(name, out=None):
    """A column's ordered target means by one window; with ``out`` for the model that leaves that fold out."""
    y, mean, into = "yield_t", "(SELECT avg(yield_t) FROM keyed)", f"{name}__o"
    before = f"OVER (PARTITION BY {name} ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    if out is None:
        return f"round((coalesce(sum({y}) {before}, 0) + {mean}) / (count({y}) {before} + 1), 6) AS {into}"
    y, mean = f"CASE WHEN fold <> {out} THEN yield_t END", f"(SELECT avg(yield_t) FROM keyed WHERE fold <> {out})"
    frame = [f"coalesce(sum({y}) {w}, 0) + {mean}, count({y}) {w} + 1" for w in (before, f"OVER (PARTITION BY {name})")]
    seen, held = (f"round(({a.split(', count')[0]}) / (count{a.split(', count')[1]}), 6)" for a in frame)
    return f"CASE WHEN fold = {out} THEN {held} ELSE {seen} END AS {into}{out}"


@query(
    "ordered_target_encode",
    "F4 L6",
    f"WITH {CLEAN}, keyed AS (SELECT *, md5({KEY_SQL}) AS h FROM clean) "
    f"SELECT {KEYS}, {_ordered_sql('crop')}, {_ordered_sql('region')} FROM keyed",
)
def ordered_target_encode(spark, sf_dir):
    """In buckets of 5,000 rows, so that running sums go on over several also in small tables."""
    df = _saved(spark, sf_dir).select(*PARCEL_KEY, "crop", "region", TARGET)
    out = features.ordered_target_encode(df, ["crop", "region"], TARGET, PARCEL_KEY, bucket_rows=5_000)
    return clean.round_columns(out.drop("crop", "region", TARGET), {"crop__o": 6, "region__o": 6})


@query(
    "ordered_target_encode_folds",
    "F4 L6 L7",
    f"WITH {CLEAN}, keyed AS (SELECT *, md5({KEY_SQL}) AS h, CAST(('0x' || substr(md5({KEY_SQL}), 1, 8))::BIGINT % 5 AS INT) AS fold FROM clean) "
    f"SELECT {KEYS}, {', '.join(_ordered_sql('weather', k) for k in (0, 3))} FROM keyed",
)
def ordered_target_encode_folds(spark, sf_dir):
    """For the models of two folds in the same pass: rows they leave out get the mean over all they see."""
    df = sampling.assign_folds(_parcels(spark, sf_dir), 5, PARCEL_KEY, exact=False).select(*PARCEL_KEY, "weather", "fold", TARGET)
    out = features.ordered_target_encode(staged(df, "folds"), ["weather"], TARGET, PARCEL_KEY, fold="fold", folds=[0, 3], bucket_rows=5_000)
    return clean.round_columns(out.drop("weather", "fold", TARGET), {"weather__o0": 6, "weather__o3": 6})


@query(
    "impute_median",
    "F5",
    f"WITH {PANEL} SELECT area, yr, round(coalesce(TRY_CAST(rain_mm AS DOUBLE), "
    "(SELECT median(TRY_CAST(rain_mm AS DOUBLE)) FROM rain_raw)), 6) AS rain_mm FROM rain_raw",
)
def impute_median(spark, sf_dir):
    rain = clean.rename_columns(views.rain_raw(spark, sf_dir), {" area": "area"})
    return clean.round_columns(features.impute_median(clean.coerce_numeric(rain, "rain_mm"), ["rain_mm"]), {"rain_mm": 6})


# ---- sufficient statistics and linear models ----------------------------------------

SMALL = FeatureSpec(("rainfall_mm", "days_to_harvest"), ("fertilizer_used",), ("crop", "weather"), TARGET)


@query(
    "gram",
    "L3",
    f"WITH {CLEAN}, f AS (SELECT CAST(('0x' || substr(md5({KEY_SQL}), 1, 8))::BIGINT % 5 AS INT) AS fold, ["
    "{'o': 0, 'p': '', 'l': NULL::VARCHAR, 'v': 1.0::DOUBLE}, {'o': 1, 'p': 'rainfall_mm', 'l': NULL, 'v': rainfall_mm}, "
    "{'o': 2, 'p': 'days_to_harvest', 'l': NULL, 'v': days_to_harvest::DOUBLE}, {'o': 3, 'p': 'yield_t', 'l': NULL, 'v': yield_t}, "
    "{'o': 4, 'p': 'fertilizer_used', 'l': NULL, 'v': fertilizer_used::INT::DOUBLE}, {'o': 5, 'p': 'crop', 'l': crop, 'v': 1.0}, "
    "{'o': 6, 'p': 'weather', 'l': weather, 'v': 1.0}] AS e FROM clean) "
    "SELECT fold, a.p AS parent_i, a.l AS level_i, b.p AS parent_j, b.l AS level_j, round(sum(a.v * b.v) / 1000, 4) AS thousands "
    "FROM f, unnest(f.e) AS t1(a), unnest(f.e) AS t2(b) WHERE a.o <= b.o GROUP BY ALL",
)
def gram_entries(spark, sf_dir):
    table = gram.gram_table(_folds(spark, sf_dir), SMALL, "fold")
    return table.withColumn("thousands", F.round(F.col("value") / 1000, 4)).drop("value")


def _pair_sql(x1, x2, alpha, train, source):
    """Closed-form ridge of two standardised features: one row per model m with the raw
    slopes and the intercept.  ``train`` says which rows of ``source`` f each m sees."""
    return f"""
 g AS (SELECT m, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2,
   covar_pop(x1, x2) / (stddev_pop(x1) * stddev_pop(x2)) AS r, covar_pop(x1, y) / stddev_pop(x1) AS c1,
   covar_pop(x2, y) / stddev_pop(x2) AS c2, avg(y) AS yb
  FROM (SELECT k.m, {x1} AS x1, {x2} AS x2, f.yield_t AS y FROM {source} f, k WHERE {train}) GROUP BY m),
 b AS (SELECT *, n * ((n + {alpha}) * c1 - n * r * c2) / (pow(n + {alpha}, 2) - pow(n * r, 2)) AS b1,
   n * ((n + {alpha}) * c2 - n * r * c1) / (pow(n + {alpha}, 2) - pow(n * r, 2)) AS b2 FROM g)"""


def _pair_table(model: LinearModel, spark):
    rows = [("intercept", model.intercept)] + [(n, c) for n, (c, _, _) in model.numerics.items()]
    table = spark.createDataFrame([(n, float(v)) for n, v in rows], "feature string, coef double")
    return clean.round_columns(table, {"coef": 6})


def _pair_rows(alpha):
    return (
        f"WITH {CLEAN}, k AS (SELECT 0 AS m), {_pair_sql('rainfall_mm', 'temperature_c', alpha, 'true', 'clean')} "
        "SELECT 'intercept' AS feature, round(yb, 6) AS coef FROM b UNION ALL SELECT 'rainfall_mm', round(b1, 6) FROM b "
        "UNION ALL SELECT 'temperature_c', round(b2, 6) FROM b"
    )


@query("linear_regression", "L1", _pair_rows("0.0"))
def linear_regression(spark, sf_dir):
    return _pair_table(linear.linear_regression(_saved(spark, sf_dir), PAIR), spark)


@query("ridge", "L2", _pair_rows("25.0"))
def ridge(spark, sf_dir):
    return _pair_table(linear.ridge(_saved(spark, sf_dir), PAIR, 25.0), spark)


@query(
    "ridge_stationarity",
    "L2",
    f"WITH {CLEAN} SELECT parent, level, true AS stationary FROM ("
    + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS parent, {c} AS level FROM clean" for c in CATEGORICALS)
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', NULL" for c in [*NUMERICS, *BOOLEANS])
    + ")",
)
def ridge_stationarity(spark, sf_dir):
    """The full model: for every encoded feature, sum(z * residual) = alpha * coefficient,
    checked by a second aggregation over the rows."""
    alpha, df = 1.0, _saved(spark, sf_dir)
    model = linear.ridge(df, SPEC, alpha)
    scored = df.withColumn("_e", F.col(TARGET) - model.raw())
    z = [((p, None), (F.col(p) - m) / s, c) for p, (c, m, s) in model.numerics.items()]
    z += [((p, None), F.col(p).cast("double"), c) for p, c in model.booleans.items()]
    z += [((p, k), (F.col(p) == k).cast("double"), c) for p, lv in model.levels.items() for k, c in lv.items()]
    cells = [
        F.struct(
            F.lit(p).alias("parent"), F.lit(k).cast("string").alias("level"),
            (F.abs(F.sum(value * F.col("_e")) - alpha * c) < 1e-5).alias("stationary"),
        )
        for (p, k), value, c in z
    ]
    return scored.agg(F.array(*cells).alias("m")).select(F.inline("m"))


FOLD_SQL = f"f AS (SELECT *, CAST(('0x' || substr(md5({KEY_SQL}), 1, 8))::BIGINT % 5 AS INT) AS fold FROM clean)"
FOLD_KEYS = "k AS (SELECT CAST(unnest(range(5)) AS INT) AS m)"
SCORED_SQL = """
 e AS (SELECT b.m, f.fold = b.m AS held, f.yield_t AS y, yb + b1 * ({x1} - m1) / s1 + b2 * ({x2} - m2) / s2 AS p FROM {source} f, b),
 sc AS (SELECT m, held, count(*) AS rows, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - p)) AS mae,
  sqrt(avg(pow(y - p, 2))) AS rmse FROM e GROUP BY m, held)"""


@query(
    "cross_validate",
    "L7 M11",
    f"WITH {CLEAN}, {FOLD_SQL}, {FOLD_KEYS}, {_pair_sql('rainfall_mm', 'temperature_c', '25.0', 'f.fold <> k.m', 'f')}, "
    + SCORED_SQL.format(x1="rainfall_mm", x2="temperature_c", source="f")
    + " SELECT a.m AS fold, a.rows AS train_rows, round(a.r2, 6) AS train_r2, round(a.mae, 6) AS train_mae, round(a.rmse, 6) AS train_rmse, "
    "v.rows AS val_rows, round(v.r2, 6) AS val_r2, round(v.mae, 6) AS val_mae, round(v.rmse, 6) AS val_rmse, "
    "round(a.r2 - v.r2, 6) AS overfit_gap_r2 FROM sc a JOIN sc v ON a.m = v.m AND NOT a.held AND v.held",
)
def cross_validate(spark, sf_dir):
    run = experiments.cross_validate(_folds(spark, sf_dir), PAIR, "ridge", alpha=25.0)
    digits = {f"{s}_{m}": 6 for s in ("train", "val") for m in ("r2", "mae", "rmse")}
    return clean.round_columns(run.metrics, {**digits, "overfit_gap_r2": 6})


@query(
    "cross_validate_from_gram",
    "L7 L3",
    f"WITH {CLEAN}, {FOLD_SQL}, {FOLD_KEYS}, {_pair_sql('rainfall_mm', 'temperature_c', '25.0', 'f.fold <> k.m', 'f')}, "
    + SCORED_SQL.format(x1="rainfall_mm", x2="temperature_c", source="f")
    + " SELECT m AS fold, round(r2, 6) AS val_r2, round(rmse, 6) AS val_rmse, rows AS val_rows FROM sc WHERE held",
)
def cross_validate_from_gram(spark, sf_dir):
    fitted = gram.collect_gram(_folds(spark, sf_dir), PAIR, "fold")
    df = experiments.linear_cv_from_gram(spark, fitted, 25.0).select("fold", "val_r2", "val_rmse", "val_rows")
    return clean.round_columns(df, {"val_r2": 6, "val_rmse": 6})


ALPHAS = experiments.alpha_draws()


WIDE_SQL = """
WITH r AS (SELECT l_partkey AS g, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
m AS (SELECT avg(q) AS qm, stddev_pop(q) AS qs, avg(y) AS ym FROM r),
c AS (SELECT g, count(*) AS n, sum((q - qm) / qs) AS s, sum(y - ym) AS t FROM r, m GROUP BY g),
w AS (SELECT sum(n / (n + 1.0)) AS a11, sum(s / (n + 1.0)) AS a12, sum(t / (n + 1.0)) AS b1 FROM c),
k AS (SELECT count(*) + 1.0 AS b22, sum((q - qm) / qs * (y - ym)) AS xy FROM r, m),
z AS (SELECT b22 - (SELECT sum(s * s / (n + 1.0)) FROM c) AS a22, xy - (SELECT sum(s * t / (n + 1.0)) FROM c) AS b2 FROM k),
u AS (SELECT (b1 * a22 - a12 * b2) / (a11 * a22 - a12 * a12) AS b0, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS bq FROM w, z)
SELECT CAST(g AS VARCHAR) AS part, round((t - n * b0 - s * bq) / (n + 1.0), 4) AS coef, round(b0 + ym, 4) AS intercept, round(bq, 4) AS slope FROM c, u, m
"""


@query("ridge_wide", "L2 F1", WIDE_SQL)
def ridge_wide(spark, sf_dir):
    """Price by quantity and part: one coefficient a part, however many there are.  The SQL
    takes the parts out of the normal equations in closed form."""
    df = views.table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    model = wide.ridge_wide(df, FeatureSpec(("l_quantity",), (), ("l_partkey",), "l_extendedprice"), 1.0)
    return model.levels.select(
        F.col("level").alias("part"), F.round("coef", 4).alias("coef"), F.round(F.lit(model.intercept), 4).alias("intercept"),
        F.round(F.lit(model.numerics["l_quantity"][0]), 4).alias("slope"),
    )


@query("ridge_wide_pair", "L2 F1")
def ridge_wide_pair(spark, sf_dir):
    """Price by quantity, part and supplier: coefficients of both categories' levels.  No closed
    form; tested against the dense ridge."""
    df = views.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    model = wide.ridge_wide(df, FeatureSpec(("l_quantity",), (), ("l_partkey", "l_suppkey"), "l_extendedprice"), 5.0)
    return clean.round_columns(model.levels, {"coef": 4})


@query(
    "random_search",
    "L10",
    f"WITH {CLEAN}, {FOLD_SQL}, k AS (SELECT t * 10 + fo AS m, t, fo, alpha FROM "
    f"(SELECT unnest(range({len(ALPHAS)})) AS t, unnest([{', '.join(repr(a) + '::DOUBLE' for a in ALPHAS)}]) AS alpha), (SELECT unnest(range(5)) AS fo)), "
    "g AS (SELECT fo, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, "
    " covar_pop(x1, x2) / (stddev_pop(x1) * stddev_pop(x2)) AS r, covar_pop(x1, y) / stddev_pop(x1) AS c1, "
    " covar_pop(x2, y) / stddev_pop(x2) AS c2, avg(y) AS yb FROM (SELECT q.fo, rainfall_mm AS x1, temperature_c AS x2, yield_t AS y "
    " FROM f, (SELECT unnest(range(5)) AS fo) q WHERE f.fold <> q.fo) GROUP BY fo), "
    "b AS (SELECT t, alpha, g.*, n * ((n + alpha) * c1 - n * r * c2) / (pow(n + alpha, 2) - pow(n * r, 2)) AS b1, "
    " n * ((n + alpha) * c2 - n * r * c1) / (pow(n + alpha, 2) - pow(n * r, 2)) AS b2 FROM k JOIN g USING (fo)), "
    "e AS (SELECT t, alpha, b.fo, yield_t AS y, yb + b1 * (rainfall_mm - m1) / s1 + b2 * (temperature_c - m2) / s2 AS p FROM f JOIN b ON f.fold = b.fo), "
    "s AS (SELECT t, alpha, fo, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - p)) AS mae FROM e GROUP BY t, alpha, fo) "
    "SELECT CAST(t AS INT) AS trial, round(alpha, 6) AS alpha, round(avg(r2), 6) AS mean_val_r2, round(stddev_pop(r2), 6) AS std_val_r2, "
    "round(avg(mae), 6) AS mean_val_mae FROM s GROUP BY t, alpha",
)
def random_search(spark, sf_dir):
    trials = experiments.random_search(_folds(spark, sf_dir), PAIR)
    return clean.round_columns(trials, {"alpha": 6, "mean_val_r2": 6, "std_val_r2": 6, "mean_val_mae": 6})


def _arm_sql(tag, x1, x2):
    """Fold scores of one arm, its tables named with a tag; without x2 the second slope
    is zero."""
    body = _pair_sql(x1, x2 or x1, "1.0", "f.fold <> k.m", "f") + "," + SCORED_SQL.format(x1=x1, x2=x2 or x1, source="f")
    if x2 is None:
        body = body.replace("covar_pop(x1, x2) / (stddev_pop(x1) * stddev_pop(x2)) AS r", "0.0 AS r")
        body = body.replace("covar_pop(x2, y) / stddev_pop(x2) AS c2", "0.0 AS c2")
    for name in ("g", "b", "e", "sc"):
        for before, after in ((f" {name} AS (", f" {name}{tag} AS ("), (f"FROM {name})", f"FROM {name}{tag})"),
                              (f"FROM {name} ", f"FROM {name}{tag} "), (f", {name})", f", {name}{tag} {name})")):
            body = body.replace(before, after)
    return body


P_SQL = "2 * (1 - (0.5 + 0.375 * abs(u) * (1 - w / 12)))"


@query(
    "ablate",
    "L8 M8",
    f"WITH {CLEAN}, {FOLD_SQL}, {FOLD_KEYS}, {_arm_sql('n', 'rainfall_mm', None)}, "
    f"{_arm_sql('x', 'rainfall_mm', 'temperature_c')}, "
    "d AS (SELECT n.m, n.r2 AS native, x.r2 AS enriched FROM scn n JOIN scx x USING (m) WHERE n.held AND x.held), "
    "t AS (SELECT avg(enriched - native) AS diff, avg(native) AS nat, avg(enriched) AS enr, "
    " avg(enriched - native) / (stddev_samp(enriched - native) / sqrt(count(*))) AS t FROM d), "
    "v AS (SELECT *, t / sqrt(1 + t * t / 4) AS u, (t * t) / (1 + t * t / 4) AS w FROM t) "
    f"SELECT 'ridge' AS model, round(t, 4) AS t, round({P_SQL}, 6) AS p, round(diff, 6) AS difference, "
    f"{P_SQL} < 0.05 AS significant, round(nat, 6) AS native_r2, round(enr, 6) AS enriched_r2, "
    f"CASE WHEN {P_SQL} < 0.05 THEN 'the arms differ' "
    "ELSE 'the arms do not differ' END AS conclusion FROM v",
)
def ablate(spark, sf_dir):
    """Rainfall alone against rainfall and temperature, on identical rows and folds."""
    one = FeatureSpec(numerics=("rainfall_mm",), target=TARGET)
    out = experiments.ablate(_folds(spark, sf_dir), one, ["temperature_c"])
    return clean.round_columns(out, {"t": 4, "p": 6, "difference": 6, "native_r2": 6, "enriched_r2": 6})


@query("ablate_enrichment", "L8 J5")
def ablate_enrichment(spark, sf_dir):
    """All native features against the same with three reference columns."""
    merged = enrichment.forward_merge(
        _saved(spark, sf_dir), views.saved_panel(spark, sf_dir), CROP_TO_ITEM, "crop", "item",
        {"rain_mm": "ref_rainfall", "pesticides_t": "ref_pesticides", "avg_temp": "ref_avg_temp"},
        "hg_ha_yield", "ref_yield",
    )
    extra = ["ref_rainfall", "ref_pesticides", "ref_avg_temp"]
    matched = staged(merged.na.drop(subset=extra), "matched")
    folds = sampling.assign_folds(matched, 5, PARCEL_KEY)
    return experiments.ablate(folds, SPEC, extra, ("ridge", "linear_regression"))


@query(
    "fit_final",
    "L11 K3",
    f"WITH {CLEAN} {_split_sql('clean', 'crop', KEY_SQL, KEYS + ', rainfall_mm, temperature_c, yield_t')}, k AS (SELECT 0 AS m), "
    + _pair_sql("rainfall_mm", "temperature_c", "1.0", "f.split = 'train'", "split")
    + ", e AS (SELECT split, yield_t AS y, yb + b1 * (rainfall_mm - m1) / s1 + b2 * (temperature_c - m2) / s2 AS p FROM split, b), "
    "sc AS (SELECT split, count(*) AS rows, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - p)) AS mae, "
    "sqrt(avg(pow(y - p, 2))) AS rmse FROM e GROUP BY split), "
    "gp AS (SELECT max(r2) FILTER (split = 'train') - max(r2) FILTER (split = 'val') AS g1, max(r2) FILTER (split = 'val') - max(r2) FILTER (split = 'test') AS g2 FROM sc) "
    "SELECT split, rows, round(r2, 6) AS r2, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(g1, 6) AS overfit_gap_r2, round(g2, 6) AS generalization_gap_r2 FROM sc, gp",
)
def fit_final(spark, sf_dir):
    parts = staged(sampling.stratified_split(_saved(spark, sf_dir), ["crop"], PARCEL_KEY), "split")
    _, table = experiments.fit_final(parts, PAIR, 1.0)
    return clean.round_columns(
        table, {"r2": 6, "mae": 6, "rmse": 6, "overfit_gap_r2": 6, "generalization_gap_r2": 6}
    )


@query("refit_best", "L12 K2 L10 S4")
def refit_best(spark, sf_dir):
    """Search, refit on all rows, save, load, and list the coefficients."""
    folds = _folds(spark, sf_dir)
    trials = experiments.random_search(folds, SPEC)
    model, best = experiments.refit_best(folds, SPEC, trials)
    path = models.save_model(spark, model, fresh_path(spark, "tuned"))
    loaded = models.load_model(spark, path)
    return explain.coefficient_table(spark, loaded).withColumn("alpha", F.lit(best["alpha"]))


def _refit_sql():
    """The search's SQL, its best trial, and the closed form with that penalty on all rows."""
    from tilth.catalog.registry import ORACLES

    search = ORACLES["random_search"]
    body, last = search.rsplit("SELECT CAST(t AS INT) AS trial", 1)
    pair = _pair_sql("rainfall_mm", "temperature_c", "alpha", "true", "clean").replace("GROUP BY m)", "GROUP BY m), ga AS (SELECT * FROM gq, best)")
    pair = pair.replace(" g AS (", " gq AS (").replace("FROM g)", "FROM ga)").replace(" b AS (", " bq AS (").replace("FROM (SELECT k.m,", "FROM (SELECT one.m,").replace(" f, k WHERE", " f, one WHERE")
    return (
        body.rstrip() + ", best AS (SELECT alpha FROM s GROUP BY t, alpha ORDER BY avg(r2) DESC, t LIMIT 1), one AS (SELECT 0 AS m), " + pair
        + " SELECT 'intercept' AS feature, round(yb, 6) AS coef, round(alpha, 6) AS alpha FROM bq UNION ALL SELECT 'rainfall_mm', round(b1, 6), round(alpha, 6) FROM bq "
        "UNION ALL SELECT 'temperature_c', round(b2, 6), round(alpha, 6) FROM bq"
    )


@query("refit_best_pair", "L12 L10", _refit_sql())
def refit_best_pair(spark, sf_dir):
    """The search over two numerics and its refit, which have a closed form."""
    folds = _folds(spark, sf_dir)
    model, best = experiments.refit_best(folds, PAIR, experiments.random_search(folds, PAIR))
    return _pair_table(model, spark).withColumn("alpha", F.round(F.lit(best["alpha"]), 6))


# ---- trees --------------------------------------------------------------------------


def _tree_metrics(df, model):
    scored = model.transform(df)
    return clean.round_columns(stats.regression_metrics(scored, TARGET, "prediction", ["split"]), {"r2": 6, "mae": 6, "rmse": 6})


def _split_rows(spark, sf_dir):
    parts = sampling.random_split(_parcels(spark, sf_dir), 0.2, PARCEL_KEY, exact=False)
    return staged(parts.select("split", *SPEC.columns), "split")


@query("random_forest", "L4 K4")
def random_forest(spark, sf_dir):
    df = _split_rows(spark, sf_dir)
    return _tree_metrics(df, trees.random_forest(df.where("split = 'train'"), SPEC))


@query("boosted_trees", "L5")
def boosted_trees(spark, sf_dir):
    df = _split_rows(spark, sf_dir)
    return _tree_metrics(df, trees.boosted_trees(df.where("split = 'train'"), SPEC))


@query("boosted_trees_categorical", "L6 F4")
def boosted_trees_categorical(spark, sf_dir):
    df = _split_rows(spark, sf_dir)
    return _tree_metrics(df, trees.boosted_trees_categorical(df.where("split = 'train'"), SPEC))


TWO_BINS = f"WITH {CLEAN}, m AS (SELECT avg(yield_t) AS base FROM clean), g AS (SELECT fertilizer_used, avg(yield_t) AS own, count(*) AS rows FROM clean GROUP BY fertilizer_used) "


@query(
    "boosted_two_bins",
    "L5",
    TWO_BINS + "SELECT fertilizer_used, rows, round(base + (1 - 0.95::DOUBLE ** 30) * (own - base), 6) AS prediction FROM g, m",
)
def boosted_two_bins(spark, sf_dir):
    """One feature of two values: every round closes a twentieth of what is left between a group's
    mean and the mean of all rows, as the SQL says in one step."""
    df = _saved(spark, sf_dir, ["fertilizer_used", TARGET])
    model = trees.boosted_trees(df, FeatureSpec(booleans=("fertilizer_used",), target=TARGET), rounds=30)
    return model.transform(df).groupBy("fertilizer_used").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("prediction"), 6).alias("prediction"))


@query(
    "boosted_categories",
    "L6",
    f"WITH {CLEAN}, m AS (SELECT avg(yield_t) AS base FROM clean), "
    "t AS (SELECT weather, (sum(yield_t) + any_value(base)) / (count(*) + 1) AS code FROM clean, m GROUP BY weather) "
    "SELECT weather, round(code, 6) AS code, true AS in_order FROM t",
)
def boosted_categories(spark, sf_dir):
    """The means that levels are scored by, and whether predictions come in their order: the
    model has that one column, and a tree on one column splits it into ranges."""
    df = _saved(spark, sf_dir, [*PARCEL_KEY, "weather", TARGET])
    model = trees.boosted_trees_categorical(df, FeatureSpec(categoricals=("weather",), target=TARGET), rounds=40, key=PARCEL_KEY)
    means = model.encoded["weather"].withColumnRenamed("level", "weather")
    found = model.transform(df).groupBy("weather").agg(F.avg("prediction").alias("p")).join(means, "weather")
    order = [F.rank().over(Window.orderBy(F.round(c, 9))) for c in ("p", "mean")]
    return found.select("weather", F.round("mean", 6).alias("code"), (order[0] <= order[1]).alias("in_order"))


@query(
    "boosted_importances",
    "E4",
    f"WITH {CLEAN}, m AS (SELECT avg(yield_t) AS base FROM clean), s AS ("
    + " UNION ALL ".join(
        f"SELECT '{b}' AS parent, sum(n * (own - base) ** 2) AS gain FROM (SELECT avg(yield_t) AS own, count(*) AS n FROM clean GROUP BY {b}), m"
        for b in ("fertilizer_used", "irrigation_used"))
    + ") SELECT parent, CASE WHEN gain = (SELECT max(gain) FROM s) THEN 1.0 ELSE 0.0 END::DOUBLE AS importance FROM s",
)
def boosted_importances(spark, sf_dir):
    """One split between two features of two values: the one that explains more takes it all."""
    spec = FeatureSpec(booleans=("fertilizer_used", "irrigation_used"), target=TARGET)
    df = _saved(spark, sf_dir, spec.columns)
    model = trees.boosted_trees(df, spec, rounds=1, leaves=2)
    return trees.tree_importances(spark, model, df, spec)


@query("tree_importances", "E4")
def tree_importances(spark, sf_dir):
    df = _saved(spark, sf_dir).select(*SPEC.columns)
    model = trees.random_forest(df, SPEC)
    return trees.tree_importances(spark, model, df, SPEC)


@query("ridge_by_rows", "L2", f"WITH {CLEAN} SELECT count(*) AS rows, true AS same FROM clean")
def ridge_by_rows(spark, sf_dir):
    """The row-based solver agrees with the sufficient statistics on every row."""
    df = _saved(spark, sf_dir).select(*SPEC.columns)
    by_rows = trees.ridge_by_rows(df, SPEC, 1.0).transform(df)
    direct = linear.ridge(df, SPEC, 1.0)
    gap = F.abs(F.col("prediction") - direct.raw())
    return by_rows.agg(F.count(F.lit(1)).alias("rows"), (F.max(gap) < 1e-6).alias("same"))


@query("compare_models", "L9 L4 L5 L6 S6")
def compare_models(spark, sf_dir):
    """Five folds of all rows, every model with its defaults; the boosted ones grow side by side."""
    kinds = ["linear_regression", "ridge", "boosted_trees", "boosted_trees_categorical", "random_forest"]
    return experiments.compare_models(_folds(spark, sf_dir), SPEC, kinds)


# ---- explanation --------------------------------------------------------------------


@query("coefficient_table", "E1")
def coefficient_table(spark, sf_dir):
    model = linear.ridge(_saved(spark, sf_dir), SPEC, 1.0)
    return clean.round_columns(explain.coefficient_table(spark, model), {"coef": 6})


@query(
    "coefficient_table_pair",
    "E1",
    f"WITH {CLEAN}, k AS (SELECT 0 AS m), {_pair_sql('rainfall_mm', 'temperature_c', '1.0', 'true', 'clean')} "
    "SELECT 'rainfall_mm' AS parent, CAST(NULL AS VARCHAR) AS level, 'numeric' AS kind, round(b1, 6) AS coef FROM b "
    "UNION ALL SELECT 'temperature_c', NULL, 'numeric', round(b2, 6) FROM b",
)
def coefficient_table_pair(spark, sf_dir):
    """The table of a model whose coefficients have a closed form."""
    model = linear.ridge(_saved(spark, sf_dir, [*PAIR.columns]), PAIR, 1.0)
    return clean.round_columns(explain.coefficient_table(spark, model), {"coef": 6})


def _effects(df, by=()):
    """Mean yield per level as the coefficient of a level, for four categories, and the
    plain slope of rainfall."""
    parts = []
    for c in CATEGORICALS:
        level = df.groupBy(*by, F.lit(c).alias("parent"), F.col(c).alias("level")).agg(F.avg(TARGET).alias("coef"))
        parts.append(level)
    slope = F.try_divide(F.covar_pop("rainfall_mm", TARGET), F.var_pop("rainfall_mm")).alias("coef")
    grouped = df.groupBy(*by) if by else df
    parts.append(grouped.agg(slope).withColumns({"parent": F.lit("rainfall_mm"), "level": F.lit(None).cast("string")}))
    return stack_results(parts)


def _effects_sql(by):
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return (
        "c AS ("
        + " UNION ALL ".join(
            f"SELECT {key}'{c}' AS parent, {c} AS level, avg(yield_t) AS coef FROM f GROUP BY {key}{c}" for c in CATEGORICALS
        )
        + f" UNION ALL SELECT {key}'rainfall_mm', NULL, regr_slope(yield_t, rainfall_mm) FROM f{group})"
    )


@query(
    "grouped_coefficients",
    "E2",
    f"WITH {CLEAN}, {FOLD_SQL}, {_effects_sql('')} SELECT parent, round(CASE WHEN count(*) = 1 THEN first(coef) ELSE max(coef) - min(coef) END, 6) AS value, "
    "CASE WHEN count(*) = 1 THEN 'coefficient' ELSE 'range' END AS type FROM c GROUP BY parent",
)
def grouped_coefficients(spark, sf_dir):
    coefs = _effects(_saved(spark, sf_dir))
    return clean.round_columns(explain.grouped_coefficients(coefs), {"value": 6})


@query(
    "fold_importances",
    "E3",
    f"WITH {CLEAN}, {FOLD_SQL}, {_effects_sql('fold')}, p AS (SELECT fold, parent, CASE WHEN count(*) = 1 THEN first(coef) ELSE max(coef) - min(coef) END AS v, "
    "CASE WHEN count(*) = 1 THEN 'coefficient' ELSE 'range' END AS type FROM c GROUP BY fold, parent) "
    "SELECT parent, round(avg(v), 6) AS mean_value, round(stddev_samp(v), 6) AS std_value, max(type) AS type FROM p GROUP BY parent",
)
def fold_importances(spark, sf_dir):
    coefs = _effects(_folds(spark, sf_dir), ("fold",))
    return clean.round_columns(explain.fold_importances(coefs), {"mean_value": 6, "std_value": 6})


TERMS_SQL = (
    f"t AS (SELECT {KEYS}, {RAW_SQL} AS raw, ["
    + ", ".join(f"{{'i': {i}, 'f': '{p}', 'c': {_term_sql(p)}}}" for i, p in enumerate(MODEL.parents))
    + "] AS e FROM clean), u AS (SELECT t.*, x FROM t, unnest(t.e) AS q(x)), "
    f"o AS (SELECT *, x.f AS feature, x.c AS contribution, row_number() OVER (PARTITION BY {KEYS} ORDER BY abs(x.c) DESC, x.i) AS position, "
    f"{MODEL.intercept}::DOUBLE + coalesce(sum(x.c) OVER (PARTITION BY {KEYS} ORDER BY abs(x.c) DESC, x.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u)"
)


@query(
    "contributions",
    "E5",
    f"WITH {CLEAN}, {TERMS_SQL} SELECT feature, CAST(position - 1 AS INT) AS position, count(*) AS rows, round(sum(contribution), 6) AS total FROM o GROUP BY feature, position",
)
def contributions(spark, sf_dir):
    df = explain.explain(_parcels(spark, sf_dir), MODEL).select(F.posexplode_outer("contributions").alias("position", "c"))
    out = df.groupBy("c.feature", "position").agg(F.count(F.lit(1)).alias("rows"), F.sum("c.contribution").alias("total"))
    return clean.round_columns(out, {"total": 6})


@query(
    "contribution_identity",
    "E5",
    f"WITH {CLEAN} SELECT count(*) AS rows, true AS identity FROM clean",
)
def contribution_identity(spark, sf_dir):
    """Base value plus contributions is the raw prediction, for a model fitted on the data."""
    df = _saved(spark, sf_dir)
    explained = explain.explain(df, linear.ridge(df, SPEC, 1.0))
    total = F.aggregate("contributions", F.col("base_value"), lambda a, c: a + c["contribution"])
    return explained.agg(
        F.count(F.lit(1)).alias("rows"), (F.max(F.abs(total - F.col("prediction"))) < 1e-9).alias("identity")
    )


@query(
    "running_contributions",
    "W3",
    f"WITH {CLEAN}, {TERMS_SQL} SELECT feature, CAST(position - 1 AS INT) AS position, round(sum(start), 6) AS start, round(sum(contribution), 6) AS height FROM o GROUP BY feature, position",
)
def running_contributions(spark, sf_dir):
    explained = explain.explain(_parcels(spark, sf_dir), MODEL)
    bars = explained.select(F.posexplode_outer(ranking.running_start(F.col("base_value"), F.col("contributions"))).alias("position", "b"))
    out = bars.groupBy("b.feature", "position").agg(F.sum("b.start").alias("start"), F.sum("b.height").alias("height"))
    return clean.round_columns(out, {"start": 6, "height": 6})


# ---- scoring ------------------------------------------------------------------------


@query(
    "predict",
    "V2 P15 P16",
    f"WITH {PARCELS} SELECT {KEYS}, round(CASE WHEN {RAW_SQL} IS NOT NULL THEN greatest(0.0, {RAW_SQL}) END, 3) AS predicted FROM parcels",
)
def predict(spark, sf_dir):
    return scoring.predict(views.parcels(spark, sf_dir), MODEL).select(*PARCEL_KEY, "predicted")


@query(
    "predict_explained",
    "V3",
    f"WITH {CLEAN}, {TERMS_SQL} SELECT feature, CAST(position - 1 AS INT) AS position, count(*) AS rows, round(sum(round(contribution, 4)), 4) AS total, "
    f"round(sum(round(greatest(0.0, raw), 3)), 3) AS predicted, round({MODEL.intercept}, 4)::DOUBLE AS base_value FROM o GROUP BY feature, position",
)
def predict_explained(spark, sf_dir):
    df = scoring.predict_explained(_parcels(spark, sf_dir), MODEL)
    rows = df.select("predicted", "base_value", F.posexplode_outer("contributions").alias("position", "c"))
    out = rows.groupBy("c.feature", "position", "base_value").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("c.contribution").alias("total"), F.sum("predicted").alias("predicted")
    )
    return clean.round_columns(out, {"total": 4, "predicted": 3})


MISSING_RAW = RAW_SQL.replace(_term_sql("rainfall_mm"), _term_sql("rainfall_mm", "ref_rainfall"))


@query(
    "predict_with_missing",
    "V2 V4 P15",
    f"WITH {CLEAN}, {PANEL}, {CROP_MAP}, ref AS (SELECT item, avg(rain_mm) AS ref_rainfall FROM panel GROUP BY item), "
    f"j AS (SELECT clean.*, {MISSING_RAW} AS raw FROM clean JOIN crop_map m USING (crop) LEFT JOIN ref ON m.item = ref.item) "
    "SELECT crop, count(*) AS rows, count(raw) AS predicted_rows, "
    "round(sum(round(CASE WHEN raw IS NULL THEN NULL ELSE greatest(0.0, raw) END, 3)), 3) AS predicted, count(raw) AS listed FROM j GROUP BY crop",
)
def predict_with_missing(spark, sf_dir):
    """Rain from the panel, which knows no rain for two crops: their rows get no prediction and no list."""
    merged = enrichment.forward_merge(
        _parcels(spark, sf_dir), views.saved_panel(spark, sf_dir), CROP_TO_ITEM, "crop", "item",
        {"rain_mm": "ref_rainfall"}, "hg_ha_yield", "ref_yield",
    )
    rows = scoring.predict(merged.withColumn("rainfall_mm", F.col("ref_rainfall")), MODEL)
    listed = scoring.recommend(rows, MODEL, CROPS, "crop", "listed")
    return listed.groupBy("crop").agg(
        F.count(F.lit(1)).alias("rows"), F.count("predicted").alias("predicted_rows"),
        F.round(F.sum("predicted"), 3).alias("predicted"), F.count("listed").alias("listed"),
    )


RAW_FOR_CROP = RAW_SQL.replace(_term_sql("crop"), _term_sql("crop", "v.candidate"))


@query(
    "recommend",
    "V4 J6 W2 P17",
    f"WITH {CLEAN}, v AS (SELECT unnest({CROPS}) AS candidate, unnest(range({len(CROPS)})) AS pos), "
    f"s AS (SELECT {KEYS}, c.region, v.candidate, pos, greatest(0.0, {RAW_FOR_CROP.replace(_term_sql('region'), _term_sql('region', 'c.region'))}) AS p FROM clean c, v), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY p DESC, pos) AS rank FROM s) "
    "SELECT region, candidate AS crop, CAST(rank AS INT) AS rank, CASE WHEN rank = 1 THEN 'best' ELSE 'other' END AS label, count(*) AS rows, "
    "round(sum(round(p, 3)), 3) AS predicted FROM r GROUP BY region, candidate, rank",
)
def recommend(spark, sf_dir):
    contexts = _parcels(spark, sf_dir).drop("crop")
    rows = scoring.recommended_rows(scoring.recommend(contexts, MODEL, CROPS, "crop"))
    out = rows.groupBy("region", "crop", "rank", "label").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("predicted"), 3).alias("predicted")
    )
    return out


CONTRACT = Contract(
    {"crop": ("STANDARD", "SMALL", "LARGE", "PROMO", "ECONOMY"), "region": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")},
    {"rainfall_mm": (150.5, 900.25), "temperature_c": (15.0, 38.0), "days_to_harvest": (60, 105)},
    ("fertilizer_used", "irrigation_used"),
    ("days_to_harvest",),
)
REASONS_SQL = (
    "list_filter([CASE WHEN crop = 'MEDIUM' THEN 'crop:unknown value' END, CASE WHEN rainfall_mm < 150.5 THEN 'rainfall_mm:below 150.5' END, "
    "CASE WHEN rainfall_mm > 900.25 THEN 'rainfall_mm:above 900.25' END, CASE WHEN temperature_c > 38 THEN 'temperature_c:above 38.0' END, "
    "CASE WHEN days_to_harvest > 105 THEN 'days_to_harvest:above 105' END], lambda x: x IS NOT NULL)"
)


@query(
    "validate",
    "V1",
    f"WITH {PARCELS}, c AS (SELECT {KEYS}, {REASONS_SQL} AS r FROM parcels) SELECT {KEYS}, array_to_string(r, '; ') AS reasons FROM c",
)
def validate_records(spark, sf_dir):
    every = checked(views.parcels(spark, sf_dir), CONTRACT)
    return every.select(*PARCEL_KEY, F.array_join("reasons", "; ").alias("reasons"))


@query(
    "score_stream",
    "V5 V1 V3",
    f"WITH {PARCELS}, c AS (SELECT *, len({REASONS_SQL}) = 0 AS ok FROM parcels) SELECT 'scored' AS outcome, crop, count(*) AS rows, "
    f"round(sum(round(greatest(0.0, {RAW_SQL}), 3)), 3) AS predicted FROM c WHERE ok GROUP BY crop UNION ALL "
    "SELECT 'rejected', crop, count(*), NULL FROM c WHERE NOT ok GROUP BY crop",
)
def score_stream(spark, sf_dir):
    return _streamed(spark, sf_dir, scoring_stream.PREDICT)


@query(
    "recommend_stream",
    "V5 V4",
    f"WITH {PARCELS}, c AS (SELECT *, len({REASONS_SQL.replace('crop = ', 'NULL = ')}) = 0 AS ok FROM parcels), "
    f"v AS (SELECT unnest({CROPS}) AS candidate, unnest(range({len(CROPS)})) AS pos), "
    f"s AS (SELECT {KEYS}, v.candidate, pos, greatest(0.0, {RAW_FOR_CROP}) AS p FROM c, v WHERE ok), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY p DESC, pos) AS rank FROM s) "
    "SELECT 'scored' AS outcome, candidate AS crop, count(*) AS rows, round(sum(round(p, 3)), 3) AS predicted FROM r WHERE rank = 1 GROUP BY candidate "
    "UNION ALL SELECT 'rejected', crop, count(*), NULL FROM c WHERE NOT ok GROUP BY crop",
)
def recommend_stream(spark, sf_dir):
    return _streamed(spark, sf_dir, scoring_stream.RECOMMEND)


def _streamed(spark, sf_dir, mode):
    """Parcels arrive as files in a folder; the stream takes what is there and stops."""
    base = fresh_path(spark, "stream")
    views.parcels(spark, sf_dir).write.parquet(f"{base}/in")
    source = scoring_stream.read_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema)
    run = scoring_stream.score_stream(
        source, MODEL, CONTRACT, f"{base}/out", f"{base}/rejected", f"{base}/checkpoint", mode, CROPS, "crop"
    )
    run.awaitTermination()
    scored = spark.read.parquet(f"{base}/out")
    if mode == scoring_stream.RECOMMEND:
        best = F.element_at("recommendations", 1)
        scored = scored.select(best["crop"].alias("crop"), best["predicted"].alias("predicted"))
    good = scored.groupBy(F.lit("scored").alias("outcome"), "crop").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("predicted"), 3).alias("predicted")
    )
    bad = spark.read.parquet(f"{base}/rejected").groupBy(F.lit("rejected").alias("outcome"), "crop").agg(
        F.count(F.lit(1)).alias("rows"), F.lit(None).cast("double").alias("predicted")
    )
    return good.unionByName(bad)


# ---- models and runs as tables ------------------------------------------------------


@query(
    "save_and_load_model",
    "S4 V2",
    f"WITH {CLEAN} SELECT crop, count(*) AS rows, round(sum(round(greatest(0.0, {RAW_SQL}), 3)), 3) AS predicted FROM clean GROUP BY crop",
)
def save_and_load_model(spark, sf_dir):
    path = models.save_model(spark, MODEL, fresh_path(spark, "model"))
    scored = scoring.predict(_parcels(spark, sf_dir), models.load_model(spark, path))
    return scored.groupBy("crop").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("predicted"), 3).alias("predicted"))


RUN_SQL = (
    f"WITH {CLEAN}, {FOLD_SQL}, s AS (SELECT 'rainfall_mm' AS run_name, fold, corr(rainfall_mm, yield_t) AS r, avg(yield_t) AS m FROM f GROUP BY fold "
    "UNION ALL SELECT 'temperature_c', fold, corr(temperature_c, yield_t), avg(yield_t) FROM f GROUP BY fold "
    "UNION ALL SELECT 'days_to_harvest', fold, corr(days_to_harvest, yield_t), avg(yield_t) FROM f GROUP BY fold), "
    "t AS (SELECT run_name AS run_id, run_name, round(avg(r), 6) AS r, round(avg(m), 6) AS mean_yield FROM s GROUP BY run_name) "
)


def _logged(spark, sf_dir):
    path = fresh_path(spark, "runs")
    folds = _folds(spark, sf_dir)
    for name in NUMERICS:
        scores = folds.groupBy("fold").agg(
            safe_corr(F.col(name), F.col(TARGET)).alias("r"), F.avg(TARGET).alias("mean_yield")
        )
        runs.log_run(runs.run_records(spark, name, name, params={"feature": name, "folds": 5}, tags={"group": ["single", name]}), path)
        runs.log_run(runs.metric_records(scores, name, name, ["r", "mean_yield"], step="fold"), path)
    return spark.read.parquet(path)


@query(
    "log_experiment",
    "S5 L7",
    f"WITH {CLEAN}, {FOLD_SQL}, {FOLD_KEYS}, {_pair_sql('rainfall_mm', 'temperature_c', '25.0', 'f.fold <> k.m', 'f')}, "
    + SCORED_SQL.format(x1="rainfall_mm", x2="temperature_c", source="f")
    + " SELECT 'metric' AS kind, 'val_' || m AS key, count(*) AS records, round(avg(v), 6) AS mean, CAST(max(fold) AS INT) AS last_step FROM "
    "(SELECT m AS fold, unnest(['r2', 'mae', 'rmse']) AS m, unnest([r2, mae, rmse]) AS v FROM sc WHERE held) GROUP BY m "
    "UNION ALL SELECT 'param', 'alpha', 1, 25.0, NULL UNION ALL SELECT 'tag', 'comparison', 1, NULL, NULL",
)
def log_experiment(spark, sf_dir):
    """A cross-validation leaves its parameters, its tag and each fold's metrics."""
    path = fresh_path(spark, "runs")
    run = experiments.cross_validate(_folds(spark, sf_dir), PAIR, "ridge", alpha=25.0)
    experiments.record(spark, run, path, "r1", "ridge pair", {"alpha": 25.0}, {"comparison": "pair"})
    rows = spark.read.parquet(path).where("kind <> 'metric' OR key LIKE 'val%'")
    return rows.groupBy("kind", "key").agg(
        F.count(F.lit(1)).alias("records"), F.round(F.avg(F.col("value").try_cast("double")), 6).alias("mean"),
        F.max("step").alias("last_step"),
    )


@query("log_run", "S5", RUN_SQL + "SELECT * FROM t")
def log_run(spark, sf_dir):
    df = runs.run_metrics(_logged(spark, sf_dir), ["r", "mean_yield"])
    return clean.round_columns(df, {"r": 6, "mean_yield": 6})


@query("run_leaderboard", "S6", RUN_SQL + "SELECT * FROM t ORDER BY r DESC LIMIT 1")
def run_leaderboard(spark, sf_dir):
    df = runs.run_metrics(_logged(spark, sf_dir), ["r", "mean_yield"])
    return clean.round_columns(runs.run_leaderboard(df, "r", 1), {"r": 6, "mean_yield": 6})


# ---- enrichment and multivariate analysis -------------------------------------------


@query(
    "forward_merge",
    "A1 J3 P12",
    f"WITH {CLEAN}, {PANEL}, {CROP_MAP}, ref AS (SELECT item, avg(rain_mm) AS a, avg(pesticides_t) AS b, avg(avg_temp) AS c, median(hg_ha_yield) / 10000 AS d FROM panel GROUP BY item) "
    "SELECT crop, m.item AS crop_harmonized, count(*) AS rows, round(avg(a), 5) AS ref_rainfall, round(avg(b), 5) AS ref_pesticides, "
    "round(avg(c), 5) AS ref_avg_temp, round(avg(d), 5) AS ref_yield, round(avg(yield_t), 5) AS yield_t FROM clean JOIN crop_map m USING (crop) LEFT JOIN ref ON m.item = ref.item GROUP BY crop, m.item",
)
def forward_merge(spark, sf_dir):
    names = {"rain_mm": "ref_rainfall", "pesticides_t": "ref_pesticides", "avg_temp": "ref_avg_temp"}
    merged = enrichment.forward_merge(
        _parcels(spark, sf_dir), views.saved_panel(spark, sf_dir), CROP_TO_ITEM, "crop", "item", names, "hg_ha_yield", "ref_yield"
    )
    shown = [*names.values(), "ref_yield", TARGET]
    return merged.groupBy("crop", "crop_harmonized").agg(
        F.count(F.lit(1)).alias("rows"), *[F.round(F.avg(c), 5).alias(c) for c in shown]
    )


REVERSE = {
    "rainfall_mm": "d1_rainfall", "temperature_c": "d1_temperature", "fertilizer_used": "d1_fertilizer_rate",
    "irrigation_used": "d1_irrigation_rate", "days_to_harvest": "d1_days", "yield_t": "d1_yield",
}


@query(
    "reverse_merge",
    "A2 J3 P7 P11",
    f"WITH {CLEAN}, {PANEL}, {CROP_MAP}, prof AS (SELECT item, avg(rainfall_mm) AS a, avg(CAST(fertilizer_used AS INT)) AS b, avg(yield_t) AS c, "
    "avg(temperature_c) AS t, avg(CAST(irrigation_used AS INT)) AS ir, avg(days_to_harvest) AS dy "
    "FROM clean JOIN crop_map USING (crop) WHERE item IS NOT NULL GROUP BY item) "
    "SELECT area, p.item, yr, avg_temp, round(hg_ha_yield / 10000, 6) AS t_ha, round(a, 6) AS d1_rainfall, round(b, 6) AS d1_fertilizer_rate, round(c, 6) AS d1_yield, "
    "round(t, 6) AS d1_temperature, round(ir, 6) AS d1_irrigation_rate, round(dy, 6) AS d1_days "
    "FROM (SELECT DISTINCT * FROM panel) p LEFT JOIN prof ON p.item = prof.item",
)
def reverse_merge(spark, sf_dir):
    df = enrichment.reverse_merge(
        views.panel(spark, sf_dir), _parcels(spark, sf_dir), CROP_TO_ITEM, "crop", "item", REVERSE, "hg_ha_yield", "t_ha"
    )
    names = ["t_ha", *REVERSE.values()]
    return clean.round_columns(df.select("area", "item", "yr", "avg_temp", *names), {n: 6 for n in names})


PCA_COLUMNS = ["rain_mm", "pesticides_t", "avg_temp"]
# eigenvalues and vectors of a 3 x 3 correlation matrix in closed form
EIGEN_SQL = (
    f"WITH {PANEL}, c AS (SELECT corr(rain_mm, pesticides_t) AS a, corr(rain_mm, avg_temp) AS b, corr(pesticides_t, avg_temp) AS d FROM panel), "
    "h AS (SELECT *, sqrt((a * a + b * b + d * d) / 3) AS p FROM c), w AS (SELECT *, acos(greatest(-1, least(1, a * b * d / pow(p, 3)))) / 3 AS phi FROM h), "
    "l AS (SELECT a, b, d, unnest([1, 2, 3]) AS component, unnest([1 + 2 * p * cos(phi), 1 + 2 * p * cos(phi + 4 * pi() / 3), 1 + 2 * p * cos(phi + 2 * pi() / 3)]) AS v FROM w), "
    "x AS (SELECT component, v, a * d - b * (1 - v) AS x1, a * b - d * (1 - v) AS x2, pow(1 - v, 2) - a * a AS x3 FROM l), "
    "u AS (SELECT component, v, x1 / sqrt(x1*x1 + x2*x2 + x3*x3) AS u1, x2 / sqrt(x1*x1 + x2*x2 + x3*x3) AS u2, x3 / sqrt(x1*x1 + x2*x2 + x3*x3) AS u3 FROM x), "
    "s AS (SELECT *, CASE WHEN greatest(u1, u2, u3) >= -least(u1, u2, u3) THEN 1 ELSE -1 END AS sg FROM u) "
)


@query("pca_leading", "M5")
def pca_leading(spark, sf_dir):
    """The first axes of the 64 components of the vectors, without a matrix of all pairs."""
    df = views.table(spark, sf_dir, "embeddings")
    # vectors without a component take no part
    df = df.select(*[F.col("embedding")[i].alias(f"e{i}") for i in range(64)]).na.drop()
    axes = multivariate.leading_axes(df, [f"e{i}" for i in range(64)], k=5)
    return clean.round_columns(axes.variance_table(spark), {"eigenvalue": 6, "percent": 6, "cumulative": 6})


@query("famd_leading", "M6 M7")
def famd_leading(spark, sf_dir):
    """Mixed axes with a category of thousands of levels, the ship date, and what each column adds to them."""
    df = views.table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_shipdate", "l_returnflag", "l_linestatus")
    axes = multivariate.leading_axes(df, ["l_quantity", "l_extendedprice", "l_discount"], ["l_shipdate", "l_returnflag", "l_linestatus"], k=2)
    table = axes.contribution_table(spark).join(axes.variance_table(spark).select("component", "eigenvalue"), "component")
    return clean.round_columns(table, {"contribution": 6, "eigenvalue": 6})


@query(
    "pca_variance",
    "M5 W4",
    EIGEN_SQL + "SELECT CAST(component AS INT) AS component, round(v, 6) AS eigenvalue, round(100 * v / 3, 5) AS percent, "
    "round(sum(100 * v / 3) OVER (ORDER BY component), 5) AS cumulative FROM s",
)
def pca_variance(spark, sf_dir):
    axes = multivariate.pca(views.saved_panel(spark, sf_dir), PCA_COLUMNS)
    return clean.round_columns(axes.variance_table(spark), {"eigenvalue": 6, "percent": 5, "cumulative": 5})


@query(
    "pca_loadings",
    "M5",
    EIGEN_SQL + "SELECT unnest(['rain_mm', 'pesticides_t', 'avg_temp']) AS parent, CAST(component AS INT) AS component, "
    "round(unnest([sg * u1, sg * u2, sg * u3]), 5) AS loading FROM s",
)
def pca_loadings(spark, sf_dir):
    axes = multivariate.pca(views.saved_panel(spark, sf_dir), PCA_COLUMNS)
    return clean.round_columns(axes.loading_table(spark).drop("level"), {"loading": 5})


@query(
    "pca_circle",
    "M5",
    EIGEN_SQL + ", r AS (SELECT component, unnest(['rain_mm', 'pesticides_t', 'avg_temp']) AS parent, round(unnest([sg * u1, sg * u2, sg * u3]), 5) AS q FROM s) "
    "SELECT a.parent, a.q AS x, b.q AS y FROM r a JOIN r b USING (parent) WHERE a.component = 1 AND b.component = 2",
)
def pca_circle(spark, sf_dir):
    axes = multivariate.pca(views.saved_panel(spark, sf_dir), PCA_COLUMNS)
    return clean.round_columns(axes.circle_table(spark, 1, 2).drop("level"), {"x": 5, "y": 5})


@query(
    "pca_scores",
    "M5",
    f"WITH {CLEAN}, n AS (SELECT count(*) AS rows FROM clean) SELECT CAST(unnest(range(1, 6)) AS INT) AS component, rows, true AS centred, true AS variance_is_eigenvalue FROM n",
)
def pca_scores(spark, sf_dir):
    """Scores of all rows on five axes: mean 0, and their variance is the eigenvalue."""
    df = _saved(spark, sf_dir)
    axes = multivariate.pca(df, ["rainfall_mm", "temperature_c", *BOOLEANS, "days_to_harvest"])
    scored = axes.transform(df)
    cells = [
        F.struct(
            F.lit(i + 1).alias("component"), F.count(F.lit(1)).alias("rows"),
            (F.abs(F.avg(f"PC{i + 1}")) < 1e-8).alias("centred"),
            (F.abs(F.var_pop(f"PC{i + 1}") - float(axes.values[i])) < 1e-8).alias("variance_is_eigenvalue"),
        )
        for i in range(axes.k)
    ]
    return scored.agg(F.array(*cells).alias("m")).select(F.inline("m"))


MIXED = [*CATEGORICALS, *BOOLEANS]


@query(
    "famd",
    "M6",
    f"WITH {CLEAN} SELECT 3.0::DOUBLE + "
    + " + ".join(f"count(DISTINCT {c}) - 1" for c in MIXED)
    + " AS inertia, true AS all_axes_add_up, CAST(5 AS INT) AS axes FROM clean",
)
def famd(spark, sf_dir):
    """Total inertia is numerics plus levels minus categories, and all axes add up to it."""
    df = _saved(spark, sf_dir)
    axes = multivariate.famd(df, NUMERICS, MIXED, 5)
    every = multivariate.famd(df, NUMERICS, MIXED, None)
    rows = [(round(axes.inertia, 6), bool(abs(every.values.sum() - axes.inertia) < 1e-8), axes.k)]
    return spark.createDataFrame(rows, "inertia double, all_axes_add_up boolean, axes int")


PANEL_KEY = ["area", "item", "yr", "avg_temp"]
PANEL_FOLDS = (
    "p AS (SELECT DISTINCT * FROM panel), prof AS (SELECT item, avg(rainfall_mm) AS d1_rainfall FROM parcels_clean "
    "JOIN crop_map USING (crop) WHERE item IS NOT NULL GROUP BY item), "
    "f AS (SELECT p.*, d1_rainfall, hg_ha_yield / 10000 AS yield_t, "
    "CAST(('0x' || substr(md5(area || '|' || p.item || '|' || yr || '|' || avg_temp || '|42'), 1, 8))::BIGINT % 5 AS INT) AS fold "
    "FROM p JOIN prof ON p.item = prof.item WHERE pesticides_t IS NOT NULL AND avg_temp IS NOT NULL AND hg_ha_yield IS NOT NULL)"
)


def _panel_folds(spark, sf_dir):
    """The reverse-merged panel with folds, written once."""
    merged = enrichment.reverse_merge(
        views.panel(spark, sf_dir), _parcels(spark, sf_dir), CROP_TO_ITEM, "crop", "item", REVERSE, "hg_ha_yield", "t_ha"
    )
    return staged(sampling.assign_folds(merged, 5, PANEL_KEY), "panel-folds")


@query(
    "ablate_panel",
    "L8",
    f"WITH {CLEAN.replace('clean AS', 'parcels_clean AS')}, {PANEL}, {CROP_MAP}, {PANEL_FOLDS}, {FOLD_KEYS}, {_arm_sql('n', 'avg_temp', None)}, "
    f"{_arm_sql('x', 'avg_temp', 'd1_rainfall')}, "
    "d AS (SELECT n.m, n.r2 AS native, x.r2 AS enriched FROM scn n JOIN scx x USING (m) WHERE n.held AND x.held) "
    "SELECT 'ridge' AS model, round(avg(enriched - native), 5) AS difference, round(avg(native), 5) AS native_r2, round(avg(enriched), 5) AS enriched_r2 FROM d",
)
def ablate_panel(spark, sf_dir):
    """The panel's temperature alone against the same with the parcels' rain."""
    one = FeatureSpec(numerics=("avg_temp",), target="t_ha")
    out = experiments.ablate(_panel_folds(spark, sf_dir), one, ["d1_rainfall"])
    return clean.round_columns(out.select("model", "difference", "native_r2", "enriched_r2"), {c: 5 for c in ("difference", "native_r2", "enriched_r2")})


@query("compare_models_panel", "L9")
def compare_models_panel(spark, sf_dir):
    """The panel's own features, linear models and the boosted one, five folds."""
    spec = FeatureSpec(("rain_mm", "pesticides_t", "avg_temp"), (), ("area", "item"), "t_ha")
    kinds = ["ridge", "linear_regression", "boosted_trees_categorical"]
    return experiments.compare_models(_panel_folds(spark, sf_dir), spec, kinds)


@query("famd_eigenvalues", "M6")
def famd_eigenvalues(spark, sf_dir):
    axes = multivariate.famd(_saved(spark, sf_dir), NUMERICS, MIXED, 5)
    return clean.round_columns(axes.variance_table(spark), {"eigenvalue": 6, "percent": 4, "cumulative": 4})


@query(
    "famd_contributions",
    "M7",
    "SELECT CAST(unnest(range(1, 6)) AS INT) AS component, 9::BIGINT AS variables, 1.0::DOUBLE AS total",
)
def famd_contributions(spark, sf_dir):
    axes = multivariate.famd(_saved(spark, sf_dir), NUMERICS, MIXED, 5)
    return axes.contribution_table(spark).groupBy("component").agg(
        F.count(F.lit(1)).alias("variables"), F.round(F.sum("contribution"), 6).alias("total")
    )


def flagship(spark, sf_dir):
    """Clean, split, fit, validate and recommend a crop for every parcel of the test part,
    with the contributions behind the first choice."""
    parts = staged(sampling.stratified_split(_saved(spark, sf_dir), ["crop"], PARCEL_KEY), "split")
    model, _ = experiments.fit_final(parts, SPEC, 1.0)
    contexts = parts.where("split = 'test'")
    ranked = scoring.recommended_rows(scoring.recommend(contexts.drop("crop"), model, CROPS, "crop"))
    best = ranked.where("rank = 1")
    return scoring.predict_explained(best.drop("predicted"), model).select(
        *PARCEL_KEY, "crop", "predicted", "base_value", "contributions"
    )
