"""Experiment records as one long append-only table."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.functions.columns import col

RUN_SCHEMA = "run_id string, run_name string, kind string, key string, value string, step int"


def run_records(
    spark: SparkSession,
    run_id: str,
    run_name: str,
    params: Mapping | None = None,
    metrics: Mapping | None = None,
    tags: Mapping | None = None,
    step: int | None = None,
) -> DataFrame:
    """One row per parameter, metric and tag; nested values become JSON text."""

    def text(value):
        return value if isinstance(value, str) else json.dumps(value)

    rows = [
        (run_id, run_name, kind, key, text(value), step if kind == "metric" else None)
        for kind, group in (("param", params), ("metric", metrics), ("tag", tags))
        for key, value in (group or {}).items()
    ]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def metric_records(df: DataFrame, run_id: str, run_name: str, metrics, step: str | None = None) -> DataFrame:
    """Metric rows taken from a result table (one row per table row and metric),
    without passing the table through the driver."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("key"), col(m).cast("string").alias("value")) for m in metrics]
    )
    step_col = col(step).cast("int") if step else F.lit(None).cast("int")
    return df.select(step_col.alias("step"), F.inline(pairs)).select(
        F.lit(run_id).alias("run_id"), F.lit(run_name).alias("run_name"),
        F.lit("metric").alias("kind"), "key", "value", "step",
    )


def log_run(records: DataFrame, path: str) -> str:
    records.write.mode("append").parquet(path)
    return path


def run_metrics(runs: DataFrame, metrics) -> DataFrame:
    """Mean of each named metric per run, one column per metric."""
    wanted = runs.where((F.col("kind") == "metric") & F.col("key").isin(list(metrics)))
    return wanted.groupBy("run_id", "run_name").pivot("key", list(metrics)).agg(
        F.avg(F.col("value").try_cast("double"))
    )


def run_leaderboard(table: DataFrame, metric: str, k: int | None = None, ascending: bool = False) -> DataFrame:
    """Runs from best to worst, ties by the other columns; ``k`` keeps the first k."""
    first = col(metric).asc_nulls_last() if ascending else col(metric).desc_nulls_last()
    rest = [col(c) for c in table.columns if c != metric]
    ordered = table.orderBy(first, *rest)
    return ordered.limit(k) if k else ordered
