"""Coefficient tables, importances and exact contributions per prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.operators.linear import LinearModel

CONTRIBUTION = "array<struct<feature: string, contribution: double>>"


def coefficient_table(spark: SparkSession, model: LinearModel) -> DataFrame:
    """(parent, level, kind, coef) without the intercept, by magnitude."""
    return (
        model.table(spark)
        .where("kind <> 'intercept'")
        .orderBy(F.abs("coef").desc(), "position")
        .select("parent", "level", "kind", "coef")
    )


def grouped_coefficients(coefs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per original feature its one coefficient or, over several levels, max - min: the
    levels of one category sum to about zero whatever their effect."""
    single = F.count(F.lit(1)) == 1
    return coefs.groupBy(*by, "parent").agg(
        F.when(single, F.first("coef")).otherwise(F.max("coef") - F.min("coef")).alias("value"),
        F.when(single, "coefficient").otherwise("range").alias("type"),
    )


def fold_importances(per_fold: DataFrame) -> DataFrame:
    """From rows (fold, parent, coef): group within each fold first, then mean and sample
    deviation over the folds, by absolute mean."""
    grouped = grouped_coefficients(per_fold, ("fold",))
    return (
        grouped.groupBy("parent")
        .agg(
            F.avg("value").alias("mean_value"),
            F.stddev_samp("value").alias("std_value"),
            F.max("type").alias("type"),
        )
        .orderBy(F.abs("mean_value").desc(), "parent")
    )


def contributions(model: LinearModel | None, digits: int | None = None) -> Column:
    """Array of (feature, contribution) by magnitude; base plus their sum is the raw
    prediction.  Without a linear model the array is empty."""
    if model is None or not model.parents:
        return F.array().cast(CONTRIBUTION)
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    items = F.sort_array(
        F.array(
            *[
                F.struct(
                    (-F.abs(model.term(p))).alias("k"), F.lit(i).alias("i"),
                    F.lit(p).alias("feature"), shown(model.term(p)).alias("contribution"),
                )
                for i, p in enumerate(model.parents)
            ]
        )
    )
    # zipping the sorted fields stays in generated code, a lambda would not
    return F.arrays_zip(items["feature"], items["contribution"]).cast(CONTRIBUTION)


def explain(df: DataFrame, model: LinearModel | None) -> DataFrame:
    """Raw prediction, base value and unrounded contributions beside each row."""
    if model is None:
        return df.withColumns({"base_value": F.lit(0.0), "contributions": contributions(None)})
    return df.withColumns(
        {
            "prediction": model.raw(),
            "base_value": F.lit(model.intercept),
            "contributions": contributions(model),
        }
    )
