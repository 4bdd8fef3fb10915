"""Shapes of a distribution: histogram, box statistics, density curve, quantile trend."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.functions.columns import col
from tilth.operators.quantiles import MAX_STATES, quantiles
from tilth.session import gather_small, one_row


def histogram(df: DataFrame, name: str, bins: int) -> DataFrame:
    """Equal-width counts of every bin, empty ones included; the maximum belongs to the
    last bin.  The mean and the exact median of the column stand beside each bin."""
    v = col(name).cast("double")
    ends = one_row(df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean")))
    middle = quantiles(df, name, [0.5]).select(F.col("quantiles")[0]).scalar()
    spark = df.sparkSession
    if ends["lo"] is None:
        return spark.createDataFrame([], "bin bigint, lo double, hi double, count bigint, mean double, median double")
    lo, width = ends["lo"], (ends["hi"] - ends["lo"]) / bins
    place = F.least(F.floor((v - F.lit(lo)) / F.lit(width)) + 1, F.lit(bins)) if width > 0 else F.lit(1).cast("bigint")
    counted = df.where(v.isNotNull()).groupBy(place.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = spark.range(1, bins + 1).withColumnRenamed("id", "bin")
    return frame.join(counted, "bin", "left").select(
        "bin",
        (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lo"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("hi"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
        F.lit(ends["mean"]).alias("mean"),
        middle.alias("median"),
    )


def box_stats(df: DataFrame, name: str, by: Sequence[str] = (), max_states: int = MAX_STATES) -> DataFrame:
    """Quartiles, whiskers (the last data point within 1.5 interquartile ranges) and the
    number of points beyond them, overall or per group."""
    by = list(by)
    data = df.select(*[col(k) for k in by], col(name).cast("double").alias("_v"))
    keys = by or ["_all"]
    if by:
        data = data.na.drop(subset=by)
        q = quantiles(data, "_v", [0.25, 0.5, 0.75], by, max_states=max_states)
    else:
        data = data.withColumn("_all", F.lit(0))
        q = quantiles(data, "_v", [0.25, 0.5, 0.75], max_states=max_states).withColumn("_all", F.lit(0))
    box = q.select(
        *keys, F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("median"),
        F.col("quantiles")[2].alias("q3"),
    )
    box, _ = gather_small(box)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
    return (
        data.join(box, keys)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def kde_grid(df: DataFrame, name: str, points: int = 200, bins: int | None = 1024) -> DataFrame:
    """Gaussian density with Scott's bandwidth at equally spaced points from the minimum
    to the maximum.

    With ``bins`` every value is first moved to the centre of its bin (error below half a
    bin width), which makes the cost of the curve independent of the row count; with None
    every distinct value keeps its place.
    """
    v = col(name).cast("double")
    known = df.where(v.isNotNull()).select(v.alias("_v"))
    s = one_row(
        known.agg(
            F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"),
            F.stddev_samp("_v").alias("sd"),
        )
    )
    spark = df.sparkSession
    if s["n"] < 2 or not s["sd"]:
        return spark.createDataFrame([], "point bigint, x double, density double")
    n, lo, span = s["n"], s["lo"], s["hi"] - s["lo"]
    width = s["sd"] * n ** (-1.0 / 5.0)
    if bins:
        step = span / bins
        place = F.least(F.floor((F.col("_v") - lo) / step), F.lit(bins - 1))
        weighted = known.groupBy(place.alias("_b")).agg(F.count(F.lit(1)).alias("_w"))
        weighted = weighted.select((F.lit(lo) + (F.col("_b") + 0.5) * step).alias("_v"), "_w")
    else:
        weighted = known.groupBy("_v").agg(F.count(F.lit(1)).alias("_w"))
    grid = F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))
    x = F.lit(lo) + F.col("point") * (span / (points - 1))
    kernel = F.exp(-0.5 * F.pow((x - F.col("_v")) / width, F.lit(2.0)))
    return (
        weighted.withColumn("point", F.explode(grid))
        .groupBy("point")
        .agg(F.sum(F.col("_w") * kernel).alias("_s"))
        .select("point", x.alias("x"), (F.col("_s") / (n * width * math.sqrt(2 * math.pi))).alias("density"))
    )


def quantile_trend(df: DataFrame, x: str, y: str, q: int = 10, max_states: int = MAX_STATES) -> DataFrame:
    """Mean of y per quantile bin of x, equal edges merged; the first bin is closed on the
    left, the others are half open (lo, hi]."""
    levels = [i / q for i in range(q + 1)]
    found = one_row(quantiles(df, x, levels, max_states=max_states))["quantiles"]
    if found is None:
        raise ValueError(f"{x} has no values")
    edges = sorted(set(found))
    if len(edges) == 1:
        edges = edges * 2
    xs = col(x).cast("double")
    bins = F.array(
        *[
            F.struct(F.lit(i + 1).alias("bin"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
            for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
        ]
    )
    home = F.filter(bins, lambda b: (xs <= b["hi"]) & ((xs > b["lo"]) | ((b["bin"] == 1) & (xs >= b["lo"]))))
    return (
        df.select(F.inline(home), col(y).cast("double").alias("_y"))
        .groupBy("bin", "lo", "hi")
        .agg(F.count(F.lit(1)).alias("rows"), F.avg("_y").alias("mean"))
        .withColumn("mid", (F.col("lo") + F.col("hi")) / 2)
    )
