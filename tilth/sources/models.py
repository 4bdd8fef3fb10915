"""Saving and loading fitted models."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from tilth.operators.boosting import Ensemble
from tilth.operators.forest import Forest
from tilth.operators.linear import LinearModel


def save_model(spark: SparkSession, model: LinearModel | PipelineModel | Ensemble, path: str) -> str:
    """A linear model becomes its coefficient table, boosted trees and forests a row a tree; a pipeline Spark's own format."""
    if isinstance(model, LinearModel):
        model.table(spark).coalesce(1).write.mode("overwrite").parquet(path)
    elif isinstance(model, Ensemble):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str) -> LinearModel:
    """Load a coefficient table; a path without one is named in the error."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no saved model at {path!r}; write one with save_model first") from error
    if "coef" not in table.columns:
        raise ValueError(f"{path!r} holds no coefficient table")
    return LinearModel.from_rows(table.collect())


def save_bundle(spark: SparkSession, model: LinearModel | PipelineModel | Ensemble, path: str, **about) -> str:
    """A model together with its score, parameters and whatever else is known about it."""
    kinds = {"linear": LinearModel, "forest": Forest, "boosted": Ensemble}
    kind = next((k for k, c in kinds.items() if isinstance(model, c)), "pipeline")
    save_model(spark, model, f"{path}/model")
    about_row = [(kind, json.dumps(about, sort_keys=True))]
    spark.createDataFrame(about_row, "kind string, about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return path


def load_bundle(spark: SparkSession, path: str) -> tuple[LinearModel | PipelineModel | Ensemble, dict]:
    """The model and what was saved about it."""
    try:
        row = spark.read.parquet(f"{path}/about").first()
    except AnalysisException as error:
        raise FileNotFoundError(f"no saved bundle at {path!r}") from error
    load = {"linear": load_model, "boosted": load_boosted, "forest": load_forest}.get(row["kind"], load_pipeline)
    return load(spark, f"{path}/model"), json.loads(row["about"])


def load_pipeline(spark: SparkSession, path: str) -> PipelineModel:
    try:
        return PipelineModel.load(path)
    except Exception as error:
        raise FileNotFoundError(f"no saved pipeline at {path!r}") from error


def load_boosted(spark: SparkSession, path: str) -> Ensemble:
    try:
        return Ensemble.load(spark, path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no saved boosted trees at {path!r}") from error


def load_forest(spark: SparkSession, path: str) -> Forest:
    try:
        return Forest.load(spark, path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no saved forest at {path!r}") from error
