"""Cross-validation, model comparison, ablation, random search and the final fit.

Linear models share one aggregate: the sufficient statistics per fold.  A fold's training
matrix is the total minus the fold's own, so refits and penalty trials read no rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tilth.functions.columns import col, label_if
from tilth.operators import explain, sampling, stats, trees
from tilth.operators.boosting import Ensemble, fit_folds
from tilth.operators.forest import fit_forests
from tilth.operators.gram import FeatureSpec, Gram, collect_gram
from tilth.operators.joins import stack_results
from tilth.operators.linear import LinearModel, gram_scores, path_errors, solve, solve_path
from tilth.session import gather_small, one_row, staged
from tilth.sources import runs

METRICS = ("r2", "mae", "rmse")
#: Folds of a forest fitted side by side: their jobs are short and leave cores idle.
AT_A_TIME = 3
LINEAR = {"ridge": 1.0, "linear_regression": 0.0}
TREES: dict[str, Callable] = {"random_forest": trees.random_forest}


@dataclass
class FoldRun:
    """Fold metrics (one row per fold) and the model of each fold."""

    metrics: DataFrame
    models: dict[int, LinearModel | PipelineModel | Ensemble]


def _wide(scored: DataFrame) -> DataFrame:
    """(model, held, metrics) rows -> one row per fold with train_ and val_ columns."""
    cells = [
        F.max(F.when(F.col("held") == held, F.col(m))).alias(f"{side}_{m}")
        for side, held in (("train", False), ("val", True))
        for m in ("rows", *METRICS)
    ]
    wide = scored.groupBy(F.col("model").alias("fold")).agg(*cells)
    return stats.overfit_gap(wide)


def linear_cv(df: DataFrame, spec: FeatureSpec, fold: str = "fold", alpha: float = 1.0, gram: Gram | None = None) -> FoldRun:
    """Fit on all folds but one and score on both sides.

    Fits, R2 and RMSE come from the sufficient statistics; only the absolute errors need the
    rows, and one aggregate has a column for every model and side, so no row is repeated.
    """
    gram = gram or collect_gram(df, spec, fold)
    models = {int(k): solve(gram, alpha, leave_out=k) for k in gram.folds}
    held = {k: col(fold) == k for k in models}
    errors = {k: F.abs(col(spec.target) - m.raw()) for k, m in models.items()}
    cells = [F.avg(F.when(held[k], e)).alias(f"val{k}") for k, e in errors.items()]
    cells += [F.avg(F.when(~held[k], e)).alias(f"train{k}") for k, e in errors.items()]
    found = one_row(df.agg(*cells)) if cells else {}
    exact = linear_cv_from_gram(df.sparkSession, gram, alpha)
    mae = df.sparkSession.createDataFrame(
        [(k, found[f"train{k}"], found[f"val{k}"]) for k in models], "fold int, train_mae double, val_mae double"
    )
    columns = [f"{side}_{m}" for side in ("train", "val") for m in ("rows", *METRICS)]
    return FoldRun(stats.overfit_gap(exact.join(mae, "fold").select("fold", *columns)), models)


def linear_cv_from_gram(spark: SparkSession, gram: Gram, alpha: float = 1.0) -> DataFrame:
    """R2 and RMSE per fold from the sufficient statistics alone (no row is read)."""
    rows = []
    for k in gram.folds:
        model = solve(gram, alpha, leave_out=k)
        train, val = gram_scores(gram, model, gram.total(k)), gram_scores(gram, model, gram.parts[k])
        rows.append((int(k), train["r2"], val["r2"], train["rmse"], val["rmse"], int(train["rows"]), int(val["rows"])))
    shape = "fold int, train_r2 double, val_r2 double, train_rmse double, val_rmse double, train_rows long, val_rows long"
    return spark.createDataFrame(rows, shape)


def tree_cv(df: DataFrame, spec: FeatureSpec, fit: Callable, fold: str, folds: Sequence[int], **params) -> FoldRun:
    """One fit per fold, several at a time; encoders are refitted on the training folds."""

    def one(k: int) -> tuple:
        model = fit(df.where(col(fold) != k), spec, **params)
        scored = model.transform(df).select(
            F.lit(k).alias("model"), (col(fold) == k).alias("held"),
            col(spec.target).alias("_y"), F.col("prediction").alias("predicted"),
        )
        metrics, _ = gather_small(stats.regression_metrics(scored, "_y", "predicted", ["model", "held"]))
        return model, metrics

    with ThreadPoolExecutor(AT_A_TIME) as pool:
        done = list(pool.map(inheritable_thread_target(df.sparkSession)(one), folds))
    models = {int(k): model for k, (model, _) in zip(folds, done)}
    return FoldRun(_wide(stack_results([metrics for _, metrics in done])), models)


def _side(errors: tuple) -> tuple:
    """rows, R2, MAE and RMSE from a model's sums of errors."""
    n, squares, absolute, spread = errors
    if not n:
        return 0, None, None, None
    return n, 1.0 - squares / spread if spread > 0 else None, absolute / n, math.sqrt(squares / n)


def _shape() -> str:
    return "fold int, " + ", ".join(f"{s}_{m} {'long' if m == 'rows' else 'double'}" for s in ("train", "val") for m in ("rows", *METRICS))


def boosted_cv(
    df: DataFrame, spec: FeatureSpec, kinds: Mapping[str, Mapping], fold: str, folds: Sequence[int], key: Sequence[str] = ()
) -> dict[str, FoldRun]:
    """Boosted models of several kinds (name -> changed parameters), all folds of all of them grown
    in the same passes.  Their errors come from the residuals, so no row is scored again."""
    how = {k: replace(trees.BOOSTED[k], **params) for k, params in kinds.items()}
    found = fit_folds(df, spec, how, fold, folds, key)
    runs_by = {}
    for kind in kinds:
        rows = [(int(k), *_side(found[kind, int(k)][1].seen), *_side(found[kind, int(k)][1].held)) for k in folds]
        runs_by[kind] = FoldRun(
            stats.overfit_gap(df.sparkSession.createDataFrame(rows, _shape())), {int(k): found[kind, int(k)][0] for k in folds})
    return runs_by


def forest_cv(df: DataFrame, spec: FeatureSpec, fold: str, folds: Sequence[int], trees: int = 100, depth: int | None = None, seed: int = 42) -> FoldRun:
    """A forest a fold from rows that are binned once; errors come from the trees' leaves, so no row is scored again."""
    found = fit_forests(df, spec, trees, depth, seed, fold, folds)
    rows = [(int(k), *_side(found[int(k)][1].seen), *_side(found[int(k)][1].held)) for k in folds]
    return FoldRun(stats.overfit_gap(df.sparkSession.createDataFrame(rows, _shape())), {int(k): found[int(k)][0] for k in folds})


def cross_validate(
    df: DataFrame, spec: FeatureSpec, kind: str = "ridge", fold: str = "fold", folds: int = 5, gram: Gram | None = None, **params
) -> FoldRun:
    """``gram``: sufficient statistics of these rows, if at hand; linear models then share them."""
    if kind in LINEAR:
        return linear_cv(df, spec, fold, params.get("alpha", LINEAR[kind]), gram)
    if kind in trees.BOOSTED:
        return boosted_cv(df, spec, {kind: params}, fold, range(folds))[kind]
    if kind == "random_forest" and params.get("kind", "one_hot") == "one_hot":
        return forest_cv(df, spec, fold, range(folds), **{k: v for k, v in params.items() if k not in ("kind", "scale")})
    return tree_cv(df, spec, TREES[kind], fold, range(folds), **params)


def compare_models(
    df: DataFrame, spec: FeatureSpec, kinds: Sequence[str], fold: str = "fold", folds: int = 5,
    params: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """Mean and sample deviation of every metric per model, best mean R2 first.

    Linear models share one aggregate, boosted models the passes over the binned rows.
    """
    how = {k: (params or {}).get(k, {}) for k in kinds}
    held = staged(df.select(col(fold), *[col(c) for c in spec.columns]), "comparison")
    shared = collect_gram(held, spec, fold) if any(k in LINEAR for k in kinds) else None
    boosted = {k: how[k] for k in kinds if k in trees.BOOSTED}
    # boosting leaves cores idle between its many short passes, so the other models are fitted beside it
    with ThreadPoolExecutor(1) as pool:
        beside = inheritable_thread_target(df.sparkSession)(boosted_cv)
        growing = pool.submit(beside, held, spec, boosted, fold, range(folds)) if boosted else None
        done = {k: cross_validate(held, spec, k, fold, folds, shared, **how[k]) for k in kinds if k not in boosted}
        done |= growing.result() if growing else {}
    parts = [done[k].metrics.withColumn("model", F.lit(k)) for k in kinds]
    names = [f"{side}_{m}" for side in ("train", "val") for m in METRICS]
    table = stats.fold_summary(stack_results(parts), [*names, "overfit_gap_r2"], ["model"])
    return table.drop("std_overfit_gap_r2").orderBy(F.col("mean_val_r2").desc_nulls_last(), "model")


def ablate(
    df: DataFrame, spec: FeatureSpec, extra: Sequence[str], kinds: Sequence[str] = ("ridge",),
    fold: str = "fold", folds: int = 5, params: Mapping[str, Mapping] | None = None, level: float = 0.05,
) -> DataFrame:
    """Native against enriched features on identical rows and folds, one row per model
    with the paired t-test of the fold scores."""
    arms = {"native": spec, "enriched": spec.with_numerics(extra)}
    wanted = dict.fromkeys([fold, *arms["enriched"].columns])
    held = staged(df.na.drop(subset=list(extra)).select(*[col(c) for c in wanted]), "ablation")
    linear = any(kind in LINEAR for kind in kinds)
    grams = {arm: collect_gram(held, s, fold) for arm, s in arms.items()} if linear else {}

    def val_r2(kind: str, arm: str) -> DataFrame:
        """Fold scores; those of linear models need no row beyond the arm's statistics."""
        how = (params or {}).get(kind, {})
        if kind in LINEAR:
            scored = linear_cv_from_gram(df.sparkSession, grams[arm], how.get("alpha", LINEAR[kind]))
        else:
            scored = cross_validate(held, arms[arm], kind, fold, folds, **how).metrics
        return scored.select("fold", F.col("val_r2").alias(arm))

    tests = []
    for kind in kinds:
        scores = {arm: val_r2(kind, arm) for arm in arms}
        both = scores["native"].join(scores["enriched"], "fold")
        means = both.agg(F.avg("native").alias("native_r2"), F.avg("enriched").alias("enriched_r2"))
        test = stats.paired_ttest(both, "enriched", "native", level=level)
        tests.append(
            test.select(
                F.lit(kind).alias("model"), "t", "p", "difference", "significant",
                means.select("native_r2").scalar().alias("native_r2"),
                means.select("enriched_r2").scalar().alias("enriched_r2"),
                label_if(F.col("significant"), "the arms differ", "the arms do not differ").alias("conclusion"),
            )
        )
    return stack_results(tests)


def fold_coefficients(spark: SparkSession, models: Mapping[int, LinearModel]) -> DataFrame:
    """(fold, parent, level, kind, coef) of the models of a cross-validation."""
    parts = [m.table(spark).where("kind <> 'intercept'").withColumn("fold", F.lit(int(k))) for k, m in models.items()]
    return stack_results(parts).select("fold", "parent", "level", "kind", "coef")


def importances(
    spark: SparkSession, run: FoldRun, df: DataFrame | None = None, spec: FeatureSpec | None = None,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """(parent, mean_value, std_value, type) over the folds, by absolute mean; ``only`` keeps some
    features, such as those of an enrichment.  Tree models need the rows' schema and the spec."""
    if all(isinstance(m, LinearModel) for m in run.models.values()):
        table = explain.fold_importances(fold_coefficients(spark, run.models))
    else:
        parts = [trees.tree_importances(spark, m, df, spec) for m in run.models.values()]
        table = (
            stack_results(parts).groupBy("parent")
            .agg(F.avg("importance").alias("mean_value"), F.stddev_samp("importance").alias("std_value"))
            .withColumn("type", F.lit("importance")).orderBy(F.col("mean_value").desc(), "parent")
        )
    return table if only is None else table.where(F.col("parent").isin(list(only)))


def record(
    spark: SparkSession, run: FoldRun, path: str, run_id: str, run_name: str, params: Mapping | None = None,
    tags: Mapping | None = None,
) -> str:
    """Append an experiment to the run table: parameters, tags and every fold's metrics with its step."""
    names = [f"{side}_{m}" for side in ("train", "val") for m in METRICS] + ["overfit_gap_r2"]
    runs.log_run(runs.run_records(spark, run_id, run_name, params=params, tags=tags), path)
    return runs.log_run(runs.metric_records(run.metrics, run_id, run_name, names, step="fold"), path)


def alpha_draws(n: int = 25, low: float = 1e-3, high: float = 1e2, seed: int = 42) -> list[float]:
    """Log-uniform draws of the penalty."""
    rng = random.Random(seed)
    return [math.exp(math.log(low) + rng.random() * (math.log(high) - math.log(low))) for _ in range(n)]


def random_search(
    df: DataFrame, spec: FeatureSpec, alphas: Sequence[float] | None = None, fold: str = "fold", gram: Gram | None = None,
) -> DataFrame:
    """(trial, alpha, mean_val_r2, std_val_r2, mean_val_mae), best first.

    All trials and folds are solved from one aggregate, the trials of a fold from one
    decomposition; the absolute errors of all trials come from one pass in which a row is
    scored by the models that did not see it and is never multiplied.
    """
    alphas = list(alphas if alphas is not None else alpha_draws())
    gram = gram or collect_gram(df, spec, fold)
    paths = {int(k): solve_path(gram, alphas, leave_out=k) for k in gram.folds}
    scores = [
        (t, float(alphas[t]), k, gram_scores(gram, model, gram.parts[k])["r2"])
        for k, models in paths.items() for t, model in enumerate(models)
    ]
    r2 = df.sparkSession.createDataFrame(scores, "trial int, alpha double, fold int, r2 double")
    errors = path_errors(df, paths, fold, spec.target)
    joined = r2.join(errors, ["trial", "fold"])
    return (
        joined.groupBy("trial", "alpha")
        .agg(
            F.avg("r2").alias("mean_val_r2"),
            F.stddev_pop("r2").alias("std_val_r2"),
            F.avg("mae").alias("mean_val_mae"),
        )
        .orderBy(F.col("mean_val_r2").desc(), "trial")
    )


def refit_best(df: DataFrame, spec: FeatureSpec, trials: DataFrame) -> tuple[LinearModel, dict]:
    """Best trial refitted on all rows, with its score and parameters."""
    best = trials.orderBy(F.col("mean_val_r2").desc(), "trial").limit(1).collect()[0]
    model = solve(collect_gram(df, spec), best["alpha"])
    return model, {"alpha": best["alpha"], "trial": best["trial"], "val_r2": best["mean_val_r2"]}


def fit_final(df: DataFrame, spec: FeatureSpec, alpha: float = 1.0, split: str = "split") -> tuple[LinearModel, DataFrame]:
    """Fit on the 'train' rows, score every split once.  The table has one row per split
    and the two gaps: train minus val, val minus test."""
    model = solve(collect_gram(df.where(col(split) == "train"), spec), alpha)
    scored = df.withColumn("_p", model.raw())
    table, _ = gather_small(stats.regression_metrics(scored, spec.target, "_p", [split]))  # a row per split
    r2 = {s: F.max(F.when(col(split) == s, F.col("r2"))) for s in ("train", "val", "test")}
    gaps = table.agg(
        (r2["train"] - r2["val"]).alias("overfit"), (r2["val"] - r2["test"]).alias("generalization")
    )
    return model, table.withColumns(
        {
            "overfit_gap_r2": gaps.select("overfit").scalar(),
            "generalization_gap_r2": gaps.select("generalization").scalar(),
        }
    )


def stratified_folds(
    df: DataFrame, strata: Sequence[str], total: int, key: Sequence[str], folds: int = 5, seed: int = 42, exact: bool = True
) -> DataFrame:
    """The sample that experiments run on: equal parts of every stratum, then folds."""
    drawn = staged(sampling.stratified_sample(df, strata, total, key, seed), "sample")
    return sampling.assign_folds(drawn, folds, key, seed, exact=exact)
