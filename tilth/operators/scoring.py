"""Predictions, explanations and ranked recommendations for tables of contexts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.functions.columns import clamp_lower, col, label_if, unused
from tilth.operators.explain import contributions
from tilth.operators.linear import LinearModel
from tilth.operators.ranking import rank_candidates

SHOWN_DIGITS = 3
EXPLAINED_DIGITS = 4


def require_model(model):
    if model is None:
        raise RuntimeError("no model loaded: fit one or load one before scoring")
    return model


def predict(df: DataFrame, model: LinearModel | PipelineModel | None, into: str = "predicted") -> DataFrame:
    """One prediction per row, never below zero, rounded for display.

    Any fitted pipeline with a ``prediction`` column will do.  A row that misses a feature
    of a linear model is predicted NULL; a pipeline treats it as its stages say.
    """
    if isinstance(require_model(model), LinearModel):
        return df.withColumn(into, F.round(clamp_lower(model.raw()), SHOWN_DIGITS))
    shown = F.round(clamp_lower(F.col("prediction")), SHOWN_DIGITS).alias(into)
    return model.transform(df).select(*[col(c) for c in df.columns if c != into], shown)


def predict_explained(df: DataFrame, model: LinearModel | PipelineModel | None, into: str = "predicted") -> DataFrame:
    """The prediction with its base value and its contributions by magnitude; a model without
    coefficients has a base of 0 and no contributions."""
    if not isinstance(require_model(model), LinearModel):
        return predict(df, model, into).withColumns({"base_value": F.lit(0.0), "contributions": contributions(None)})
    return predict(df, model, into).withColumns(
        {
            "base_value": F.round(F.lit(model.intercept), EXPLAINED_DIGITS),
            "contributions": contributions(model, EXPLAINED_DIGITS),
        }
    )


def shared_sum(model: LinearModel | None, candidate: str) -> Column:
    """The prediction of a context without the candidate's own term."""
    return require_model(model).raw(without=(candidate,))


def recommendations(
    model: LinearModel | None, candidates: Sequence[str], candidate: str, shared: Column | None = None,
) -> Column:
    """All candidates of a row ranked by unrounded prediction, ties in vocabulary order,
    as array<struct<candidate, predicted, rank>>.

    A context that misses a feature has no list (NULL).
    Everything but the candidate's own term is the same for all of them (``shared``, a column
    that holds ``shared_sum``, so that it is worked out once per row); the ranking is a
    sort of a vocabulary-long array inside the row, so contexts are never shuffled.
    """
    model = require_model(model)
    shared = shared_sum(model, candidate) if shared is None else shared
    own = (lambda c: model.term(candidate, F.lit(c))) if candidate in model.parents else (lambda c: F.lit(0.0))
    scored = F.sort_array(
        F.array(
            *[
                F.struct(
                    (-p).alias("k"), F.lit(i).alias("i"), F.lit(c).alias("c"),
                    F.round(p, SHOWN_DIGITS).alias("p"),
                )
                for i, (c, p) in enumerate((c, clamp_lower(shared + own(c))) for c in candidates)
            ]
        )
    )
    ranks = F.array(*[F.lit(i + 1) for i in range(len(candidates))])
    # zipping the sorted fields stays in generated code, a lambda would not
    ranked = F.arrays_zip(scored["c"], scored["p"], ranks).cast(
        f"array<struct<`{candidate}`: string, predicted: double, rank: int>>"
    )
    return F.when(shared.isNotNull(), ranked)


def recommend(
    df: DataFrame, model: LinearModel | None, candidates: Sequence[str], candidate: str = "crop",
    into: str = "recommendations",
) -> DataFrame:
    """Ranked list per context; the contexts need no candidate column."""
    name = unused("_shared", [*df.columns, into])
    summed = df.withColumn(name, shared_sum(model, candidate))
    return summed.withColumn(into, recommendations(model, candidates, candidate, F.col(name))).drop(name)


def recommend_by_pipeline(
    df: DataFrame, model: PipelineModel, candidates: Sequence[str], ids: Sequence[str], candidate: str = "crop"
) -> DataFrame:
    """(ids, candidate, predicted, rank, label) of any fitted pipeline: every context once per
    candidate, one transform of them all, and a window over the candidates of a context."""
    listed = F.posexplode(F.array(*[F.lit(c) for c in candidates])).alias("_position", candidate)
    rows = df.select(*[col(c) for c in df.columns if c != candidate], listed)
    raw = require_model(model).transform(rows).withColumn("_raw", clamp_lower(F.col("prediction")))
    ranked = rank_candidates(raw, ids, "_raw", "_position")
    return ranked.select(
        *[col(i) for i in ids], col(candidate), F.round("_raw", SHOWN_DIGITS).alias("predicted"), "rank",
        label_if(F.col("rank") == 1, "best", "other").alias("label"),
    )


def recommended_rows(df: DataFrame, into: str = "recommendations") -> DataFrame:
    """The ranked list as rows, with the label of the best one."""
    lists = [c for c in df.columns if c != into]
    item = df.schema[into].dataType.elementType.fieldNames()
    kept = [c for c in lists if c not in item]
    # outer: a list is never empty, and a context without one keeps a row of NULLs
    rows = df.select(*kept, F.inline_outer(into))
    return rows.withColumn("label", label_if(F.col("rank") == 1, "best", "other"))
