"""Tree ensembles, and the row-based linear solver as a Spark ML pipeline.

Boosted trees are grown by ``boosting``, forests by ``forest``; a depth that is given is limited to 30, as in Spark ML.
Defaults carry the reference settings for the role; rounds, trees and depth are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.functions.columns import col
from tilth.operators.boosting import Boosting, Ensemble, fit_folds
from tilth.operators.forest import Forest, fit_forests
from tilth.operators.features import feature_positions, feature_stages, vocabulary
from tilth.operators.gram import FeatureSpec
from tilth.session import one_row, shared_dir

MAX_DEPTH = 30


def _fit(df: DataFrame, spec: FeatureSpec, kind: str, scale: bool, learner) -> PipelineModel:
    shared_dir(df.sparkSession)  # the learners cut their lineage there
    stages, _, _ = feature_stages(df, spec, kind, scale)
    return Pipeline(stages=[*stages, learner]).fit(df)


def _label(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    return df.withColumn(spec.target, col(spec.target).cast("double"))


def random_forest(
    df: DataFrame, spec: FeatureSpec, trees: int = 100, depth: int | None = None, seed: int = 42, kind: str = "one_hot", scale: bool = False,
) -> Forest | PipelineModel:
    """All features at every split; trees are grown until no split gains, unless a depth is given (beyond 30
    it is refused).

    'one_hot': a split takes one level from the others; scaling a number does not change its splits.
    'target' and 'native': trees from Spark ML on plain target means or on sets of levels, as deep as it
    grows them.
    """
    if depth is not None and depth > MAX_DEPTH:
        raise ValueError(f"depth {depth} is beyond Spark's {MAX_DEPTH}")
    if kind == "one_hot":
        return fit_forests(df, spec, trees, depth, seed)[None][0]
    learner = RandomForestRegressor(
        labelCol=spec.target, numTrees=trees, maxDepth=MAX_DEPTH if depth is None else depth, seed=seed,
        featureSubsetStrategy="all", bootstrap=True, cacheNodeIds=True, checkpointInterval=10,
    )
    return _fit(_label(df, spec), spec, kind, scale, learner)


#: The boosted models by their role: leaf-wise trees on indicator splits, and symmetric trees on
#: ordered target means.
BOOSTED = {
    "boosted_trees": Boosting(),
    "boosted_trees_categorical": Boosting(rounds=600, depth=6, leaves=64, least=1, penalty=3.0, symmetric=True, ordered=True),
}


def boosted_trees(
    df: DataFrame, spec: FeatureSpec, rounds: int = 500, rate: float = 0.05, depth: int = 8, leaves: int = 31, least: int = 20,
) -> Ensemble:
    """Gradient boosting that splits the best leaf, up to ``leaves`` leaves within ``depth``, each of
    at least ``least`` rows; categories split one level from the others."""
    how = Boosting(rounds, rate, depth, leaves, least)
    return fit_folds(df, spec, {"boosted_trees": how})["boosted_trees", None][0]


def boosted_trees_categorical(
    df: DataFrame, spec: FeatureSpec, rounds: int = 600, rate: float = 0.05, depth: int = 6, seed: int = 42,
    encoding: str = "ordered", scale: bool = False, key: Sequence[str] = (),
) -> Ensemble | PipelineModel:
    """Gradient boosting on categories as such.

    'ordered': symmetric trees on ordered target means; ``key`` tells rows apart (all columns
    without one).  'target' and 'native': trees from Spark ML on plain target means or on sets of levels.
    """
    if encoding == "ordered":
        how = replace(BOOSTED["boosted_trees_categorical"], rounds=rounds, rate=rate, depth=depth)
        found = fit_folds(df, spec, {"boosted_trees_categorical": how}, key=key, seed=seed)
        return found["boosted_trees_categorical", None][0]
    learner = GBTRegressor(
        labelCol=spec.target, maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed,
        cacheNodeIds=True, checkpointInterval=10,
    )
    if encoding == "native" and spec.categoricals:
        widest = max(len(v) for v in vocabulary(df, spec.categoricals).values())
        learner = learner.setMaxBins(max(32, widest + 1))
    return _fit(_label(df, spec), spec, encoding, scale, learner)


def ridge_by_rows(df: DataFrame, spec: FeatureSpec, alpha: float = 1.0) -> PipelineModel:
    """Ridge without sufficient statistics, for categories with too many levels for a
    p x p matrix.  Spark scales the penalty by the target's deviation and the row count."""
    labelled = _label(df, spec)
    y = one_row(labelled.agg(F.stddev_pop(col(spec.target)).alias("s"), F.count(col(spec.target)).alias("n")))
    learner = LinearRegression(
        labelCol=spec.target, regParam=alpha * (y["s"] or 1.0) / y["n"], elasticNetParam=0.0,
        standardization=False, solver="auto", tol=1e-10, maxIter=500,
    )
    return _fit(labelled, spec, "one_hot", True, learner)


def tree_importances(spark: SparkSession, model: PipelineModel | Ensemble, df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Importance per original feature, largest first."""
    if isinstance(model, Ensemble):
        totals = {p: 0.0 for p in spec.features} | model.importances()
        return spark.createDataFrame(sorted(totals.items(), key=lambda kv: (-kv[1], kv[0])), "parent string, importance double")
    encoded = PipelineModel(model.stages[:-1]).transform(df.limit(0))
    totals: dict[str, float] = {p: 0.0 for p in spec.features}
    for parent, value in zip(feature_positions(encoded, spec), model.stages[-1].featureImportances.toArray()):
        totals[parent] += float(value)
    rows = sorted(totals.items(), key=lambda kv: (-kv[1], kv[0]))
    return spark.createDataFrame(rows, "parent string, importance double")
