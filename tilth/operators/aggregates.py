"""Group summaries, counts and profiles.  Every aggregate here combines on the map side,
so a key that holds a third of the rows still leaves each task as one partial row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.functions.columns import col
from tilth.operators.quantiles import MAX_STATES, quantiles
from tilth.session import gather_small, local_if_small, one_row


def _mean(name: str) -> Column:
    return F.avg(col(name).cast("double"))


def median_by(df: DataFrame, by: Sequence[str], name: str, into: str) -> DataFrame:
    return quantiles(df, name, [0.5], by).select(*by, F.col("quantiles")[0].alias(into))


def reference_profile(
    panel: DataFrame, key: str, means: Mapping[str, str], median: str, median_into: str, factor: float = 1.0
) -> DataFrame:
    """Per key the mean of some columns and the median of one, scaled by ``factor``.
    Repeated rows count as often as they occur."""
    known = panel.where(col(key).isNotNull())
    averaged = known.groupBy(col(key)).agg(*[_mean(c).alias(n) for c, n in means.items()])
    middle = median_by(known, [key], median, "_m")
    return averaged.join(middle, key).withColumn(median_into, F.col("_m") / F.lit(float(factor))).drop("_m")


def parcel_profile(parcels: DataFrame, key: str, means: Mapping[str, str]) -> DataFrame:
    """Per non-NULL key the mean of each column; the mean of a boolean is its share of True."""
    kinds = dict(parcels.dtypes)
    cells = {c: col(c).cast("int") if kinds[c] == "boolean" else col(c) for c in means}
    return parcels.where(col(key).isNotNull()).groupBy(col(key)).agg(
        *[F.avg(cells[c].cast("double")).alias(n) for c, n in means.items()]
    )


def summarize(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Mean, median, min, max and count of a column per group (NULL keys dropped)."""
    known = df.na.drop(subset=list(by))
    plain = known.groupBy(*by).agg(
        _mean(name).alias("mean"),
        F.min(col(name)).alias("min"),
        F.max(col(name)).alias("max"),
        F.count(col(name)).alias("count"),
    )
    middle = median_by(known, by, name, "median")
    return plain.join(middle, list(by)).select(*by, "mean", "median", "min", "max", "count")


def pivot_mean(df: DataFrame, row: str, column: str, value: str, levels: Sequence | None = None) -> DataFrame:
    """Two-way table of means; without ``levels`` the column's levels are looked up
    (a bounded list: a pivot needs one output column per level)."""
    if levels is None:
        _, rows = gather_small(df.select(col(column)).where(col(column).isNotNull()).distinct(), 1000)
        if rows is None:
            raise ValueError(f"{column} has more than 1000 levels, too many for columns")
        levels = sorted(r[column] for r in rows)
    return df.where(col(row).isNotNull()).groupBy(col(row)).pivot(column, list(levels)).agg(_mean(value))


def mean_by(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    return df.where(col(key).isNotNull()).groupBy(col(key)).agg(*[_mean(c).alias(f"mean_{c}") for c in names])


QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, names: Sequence[str], max_states: int = MAX_STATES) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one row per column.

    The plain figures come from one pass; the quartiles of all columns together from the
    counts of their values, as groups of one long column.
    """
    parts = []
    for i, n in enumerate(names):
        v = col(n).cast("double")
        parts.append(
            F.struct(
                F.lit(n).alias("column_name"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
            ).alias(f"_c{i}")
        )
    wide = df.agg(*parts)
    long = wide.select(F.inline(F.array(*[f"_c{i}" for i in range(len(names))])))
    cells = F.array(
        *[F.struct(F.lit(n).alias("column_name"), col(n).cast("double").alias("value")) for n in names]
    )
    exact = quantiles(df.select(F.inline(cells)), "value", QUARTILES, ["column_name"], max_states=max_states)
    exact, _ = gather_small(exact)
    long = long.join(exact, "column_name", "left")
    q = F.col("quantiles")
    return long.select(
        "column_name", "count", "mean", "std", "min",
        q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), "max",
    )


def distinct_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct non-NULL values as rows (column_name, value): the copies collapse before
    the shuffle and no value list has to fit into one cell."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("column_name"), col(n).cast("string").alias("value")) for n in names]
    )
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()


def n_unique(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Number of distinct non-NULL values of every column."""
    names = list(names or df.columns)
    values = distinct_values(df, names)
    counted = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"))
    every = df.sparkSession.createDataFrame([(n,) for n in names], "column_name string")
    return every.join(counted, "column_name", "left").select(
        "column_name", F.coalesce("n_unique", F.lit(0).cast("bigint")).alias("n_unique")
    )


def value_counts(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and share of every non-NULL value, overall or within each group.

    The total adds up the counts, so the input is counted once and no window brings all
    values together.
    """
    known = df.where(col(name).isNotNull())
    counted = known.groupBy(*by, col(name)).agg(F.count(F.lit(1)).alias("count"))
    if not by:
        counted = local_if_small(counted)
        total = counted.agg(F.sum("count")).scalar()
        return counted.withColumn("share", F.col("count") / total)
    totals = counted.groupBy(*by).agg(F.sum("count").alias("_total"))
    return counted.join(totals, list(by)).withColumn("share", F.col("count") / F.col("_total")).drop("_total")


def group_compare(df: DataFrame, key: str, means: Mapping[str, str]) -> DataFrame:
    """Mean of each column per key, keys with an incomplete comparison dropped."""
    return (
        df.where(col(key).isNotNull())
        .groupBy(col(key))
        .agg(*[_mean(c).alias(n) for c, n in means.items()])
        .na.drop()
    )


def mean_with_and_without(df: DataFrame, value: str, name: str, excluded: Sequence) -> DataFrame:
    """Mean on all rows beside the mean without some levels, in one pass."""
    left_out = F.coalesce(col(name).isin(list(excluded)), F.lit(False))
    kept = F.when(~left_out, col(value).cast("double"))
    return df.agg(
        _mean(value).alias("mean_all"),
        F.avg(kept).alias("mean_without"),
        F.count_if(left_out).alias("rows_left_out"),
    )


def group_std(df: DataFrame, key: str, name: str) -> DataFrame:
    """Sample deviation per group, largest first."""
    return (
        df.where(col(key).isNotNull())
        .groupBy(col(key))
        .agg(F.stddev_samp(col(name)).alias("std"))
        .orderBy(F.col("std").desc_nulls_last(), col(key))
    )


def skewness(name: str) -> Column:
    """Bias-corrected skewness: the population value times sqrt(n (n - 1)) / (n - 2)."""
    n = F.count(col(name)).cast("double")
    return F.when(n > 2, F.skewness(col(name).cast("double")) * F.sqrt(n * (n - 1)) / (n - 2))


def bounds_profile(
    df: DataFrame, numerics: Sequence[str], categoricals: Sequence[str], max_levels: int = 10_000
) -> DataFrame:
    """One configuration document as a row: per numeric its true range, its suggested
    range (1st to 99th percentile) and median; per category its sorted levels.

    Whole-number columns are cut to whole numbers, the others are rounded to one digit.
    """
    probs = [0.01, 0.5, 0.99]
    kinds = dict(df.dtypes)
    _, rows = gather_small(distinct_values(df, categoricals), max_levels)
    if rows is None:
        raise ValueError(f"more than {max_levels} levels; not a closed vocabulary")
    levels = {c: sorted(r["value"] for r in rows if r["column_name"] == c) for c in categoricals}
    ends = one_row(
        df.agg(
            *[f(col(n)).alias(f"{k}{i}") for i, n in enumerate(numerics) for k, f in (("lo", F.min), ("hi", F.max))]
        )
    )
    cells = F.array(
        *[F.struct(F.lit(n).alias("column_name"), col(n).cast("double").alias("value")) for n in numerics]
    )
    _, found = gather_small(quantiles(df.select(F.inline(cells)), "value", probs, ["column_name"]))  # a row per numeric
    marks = {r["column_name"]: r["quantiles"] for r in found}
    doc = []
    for i, n in enumerate(numerics):
        q = marks[n]
        whole = kinds[n] in ("tinyint", "smallint", "int", "bigint")
        shown = [F.lit(int(x)) if whole else F.round(F.lit(float(x)), 1) for x in q]
        doc.append(
            F.struct(
                F.lit(ends[f"lo{i}"]).alias("valid_min"), F.lit(ends[f"hi{i}"]).alias("valid_max"),
                shown[0].alias("suggested_min"), shown[2].alias("suggested_max"),
                shown[1].alias("suggested_default"),
            ).alias(n)
        )
    words = [
        F.array(*[F.lit(v) for v in levels[c]]).alias(c) for c in categoricals
    ]
    one = df.sparkSession.range(1)
    return one.select(F.struct(*words).alias("categorical"), F.struct(*doc).alias("numeric"))

