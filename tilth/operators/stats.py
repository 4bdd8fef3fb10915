"""Correlation, scaling, tests and regression metrics as plain aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.functions.columns import col, two_sided_p, safe_corr
from tilth.session import importable, one_row

#: Columns from which on pairs are multiplied as blocks of an array, not as one expression each.
MANY = 33


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric and boolean columns: a boolean counts as 0 and 1."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return [n for n, t in df.dtypes if t in kinds or t.startswith("decimal")]


def as_number(df: DataFrame, name: str) -> Column:
    v = col(name)
    return v.cast("int").cast("double") if dict(df.dtypes)[name] == "boolean" else v.cast("double")


def _products(df: DataFrame, names: Sequence[str], pairs, by: Sequence[str]) -> DataFrame:
    """Correlations of the given pairs from plain sums, as struct columns _r0, _r1, ...

    A first pass finds means (subtracted before multiplying, so large offsets cost no
    digits) and which columns have missing values.  Pairs of complete columns share their
    sums; a pair with missing values has its own over its complete rows.  A side whose
    smallest and largest value agree is constant and gives NULL.  Within groups, whose means
    may lie far from the overall ones, Spark's central moments are used instead.
    """
    if by:
        v = [as_number(df, n) for n in names]
        cells = []
        for i, j in pairs:
            r = safe_corr(v[i], v[j])
            r = F.when(r.isNotNull(), F.lit(1.0) if i == j else F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
            cells.append(F.struct(F.lit(names[i]).alias("x"), F.lit(names[j]).alias("y"), r.alias("r")))
        return df.groupBy(*by).agg(F.array(*cells).alias("_cells")).select(*by, F.inline("_cells"))
    first = one_row(
        df.agg(
            *[F.avg(as_number(df, n)).alias(f"m{i}") for i, n in enumerate(names)],
            *[F.count_if(col(n).isNull()).alias(f"n{i}") for i, n in enumerate(names)],
        )
    )
    v = [as_number(df, n) - F.lit(float(first[f"m{i}"] or 0.0)) for i, n in enumerate(names)]
    holes = [bool(first[f"n{i}"]) for i in range(len(names))]
    sums: dict[str, Column] = {}

    def add(label: str, value: Column) -> Column:
        sums.setdefault(label, value.alias(label))
        return F.col(label)

    cells = []
    for i, j in pairs:
        if holes[i] or holes[j]:
            both = v[i].isNotNull() & v[j].isNotNull()
            x, y, tag = F.when(both, v[i]), F.when(both, v[j]), f"{i}_{j}"
            n = add(f"_n{tag}", F.count_if(both))
            side = lambda s, value: (f"_{s}{tag}", value)
            xs, ys = side("x", x), side("y", y)
        else:
            x, y, tag = v[i], v[j], f"{i}_{j}"
            n = add("_n", F.count(F.lit(1)))
            xs, ys = (f"_c{i}", x), (f"_c{j}", y)
        n = n.cast("double")
        mean, var, flat = [], [], F.lit(False)
        for label, value in (xs, ys):
            m = F.try_divide(add(label + "s", F.sum(value)), n)
            mean.append(m)
            var.append(F.try_divide(add(label + "q", F.sum(value * value)), n) - m * m)
            flat = flat | (add(label + "lo", F.min(value)) == add(label + "hi", F.max(value)))
        cov = F.try_divide(add(f"_p{tag}", F.sum(x * y)), n) - mean[0] * mean[1]
        r = F.when(~flat, F.try_divide(cov, F.sqrt(F.greatest(var[0] * var[1], F.lit(0.0)))))
        r = F.lit(1.0) if i == j else F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
        cells.append(F.struct(F.lit(names[i]).alias("x"), F.lit(names[j]).alias("y"), F.when(~flat, r).alias("r")))
    return df.agg(*sums.values()).select(F.inline(F.array(*cells)))


def _blocks(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Upper triangle (x, y, r) for many columns, missing values or not.

    A task turns its Arrow batches into arrays and adds up, with a mask M of what is known,
    M'M, X'M, (X*X)'M and X'X and the extremes of x where y is known: p x p numbers a task,
    whatever its rows.  Spark adds these up by pair.  Columns are shifted by their means first.
    """
    spark, p = df.sparkSession, len(names)
    importable(spark)
    slim = df.select(*[as_number(df, n).alias(f"v{i}") for i, n in enumerate(names)])
    slim = slim.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in slim.columns])
    means = one_row(slim.agg(*[F.avg(c).alias(c) for c in slim.columns]))
    centre = np.array([means[c] or 0.0 for c in slim.columns])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, p, p))
        low, high = np.full((p, p), np.inf), np.full((p, p), -np.inf)
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            seen += batch.num_rows
            x = np.stack([np.asarray(c.cast(pa.float64()).fill_null(float("nan"))) for c in batch.columns], axis=1) - centre
            known = ~np.isnan(x)
            m, x0 = known.astype(float), np.where(known, x, 0.0)
            sums += np.array([m.T @ m, x0.T @ m, (x0 * x0).T @ m, x0.T @ x0])
            for j in range(p):
                rows = x[known[:, j]]
                if len(rows):
                    low[:, j] = np.fmin(low[:, j], np.fmin.reduce(rows))
                    high[:, j] = np.fmax(high[:, j], np.fmax.reduce(rows))
        if seen:
            i, j = np.triu_indices(p)
            both = [x[i, j] for x in sums] + [sums[1][j, i], sums[2][j, i]]  # y's sums are the other triangle's
            ends = [low[i, j], high[i, j], low[j, i], high[j, i]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (i, j, *both, *ends)], names=shape)

    shape = ["i", "j", "n", "s", "q", "c", "s2", "q2", "lo", "hi", "lo2", "hi2"]
    parts = slim.mapInArrow(work, "i long, j long, " + ", ".join(f"{c} double" for c in shape[2:]))
    added = parts.groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in shape[2:8]],
        (F.min("lo") == F.max("hi")).alias("flat"), (F.min("lo2") == F.max("hi2")).alias("flat2"),
    )
    every = spark.range(p * p).select(F.expr(f"id div {p}").alias("i"), (F.col("id") % p).alias("j")).where("i <= j")
    both = every.join(added, ["i", "j"], "left")  # pairs of an empty table too
    n = F.col("n")
    mean = [F.try_divide(F.col(k), n) for k in ("s", "s2")]
    var = [F.try_divide(F.col(k), n) - m * m for k, m in zip(("q", "q2"), mean)]
    cov = F.try_divide(F.col("c"), n) - mean[0] * mean[1]
    r = F.try_divide(cov, F.sqrt(F.greatest(var[0] * var[1], F.lit(0.0))))
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    label = F.array(*[F.lit(c) for c in names])
    vary = (n > 1) & ~F.col("flat") & ~F.col("flat2")
    return both.select(label[F.col("i").cast("int")].alias("x"), label[F.col("j").cast("int")].alias("y"), F.when(vary, r).alias("r"))


def corr_matrix(
    df: DataFrame, names: Sequence[str] | None = None, by: Sequence[str] = (), digits: int | None = None
) -> DataFrame:
    """Pearson matrix as rows (x, y, r), overall or per group.

    Each pair uses the rows where both values are present.  r is NULL for a constant
    column (the diagonal too).  Only the upper triangle is computed.  From ``MANY`` columns
    on, pairs are summed as blocks of arrays instead of as expressions of their own.
    """
    names = list(names or numeric_columns(df))
    source = df.na.drop(subset=list(by)) if by else df
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    half = _blocks(source, names) if len(names) >= MANY and not by else _products(source, names, pairs, by)
    both = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    mirrored = F.when(F.col("x") == F.col("y"), F.slice(both, 1, 1)).otherwise(both)
    full = half.select(*by, "r", F.inline(mirrored)).select(*by, "x", "y", "r")
    return full.withColumn("r", F.round("r", digits)) if digits is not None else full


def corr_with_target(df: DataFrame, names: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """One column of the matrix: the correlation of each name with the target."""
    source = df.na.drop(subset=list(by)) if by else df
    every = list(dict.fromkeys([*names, target]))
    t = every.index(target)
    return _products(source, every, [(every.index(n), t) for n in names], by).select(*by, "x", "r")


def moments(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and scale of each column: population deviation, a zero one replaced by 1."""
    row = one_row(
        df.agg(
            *[
                f(as_number(df, n)).alias(f"{k}{i}")
                for i, n in enumerate(names)
                for k, f in (("m", F.avg), ("s", F.stddev_pop))
            ]
        )
    )
    return {n: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, n in enumerate(names)}


def standardize(df: DataFrame, names: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population deviation.  Two scans of the named columns: one for the
    moments (a single row), one narrow projection."""
    scale = moments(df, names)
    return df.withColumns(
        {n + suffix: (as_number(df, n) - F.lit(m)) / F.lit(s) for n, (m, s) in scale.items()}
    )


def paired_ttest(df: DataFrame, a: str, b: str, by: Sequence[str] = (), level: float = 0.05) -> DataFrame:
    """Paired t-test of a against b over complete pairs: t, two-sided p and significance.
    t and p are NULL when the differences do not vary or there are fewer than two."""
    d = col(a).cast("double") - col(b).cast("double")
    grouped = df.groupBy(*by) if by else df
    stats = grouped.agg(
        F.count(d).alias("pairs"),
        F.avg(d).alias("difference"),
        F.stddev_samp(d).alias("_sd"),
    )
    t = F.try_divide(F.col("difference"), F.col("_sd") / F.sqrt(F.col("pairs").cast("double")))
    p = F.when(F.col("t").isNotNull(), two_sided_p(F.col("t"), F.col("pairs") - 1))
    return (
        stats.withColumn("t", t)
        .withColumn("p", p)
        .withColumn("significant", F.col("p") < F.lit(level))
        .drop("_sd")
    )


def fold_summary(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), sample: bool = True) -> DataFrame:
    """Mean and deviation of metrics over folds; sample or population deviation."""
    spread = F.stddev_samp if sample else F.stddev_pop
    cells = [c for m in metrics for c in (F.avg(col(m)).alias(f"mean_{m}"), spread(col(m)).alias(f"std_{m}"))]
    return df.groupBy(*by).agg(*cells) if by else df.agg(*cells)


def regression_metrics(df: DataFrame, y: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """R2, MAE and RMSE; the total sum of squares is about the mean of the rows scored,
    and R2 is NULL when the target does not vary."""
    actual, guess = col(y).cast("double"), col(predicted).cast("double")
    error = actual - guess
    both = error.isNotNull()
    grouped = df.groupBy(*by) if by else df
    stats = grouped.agg(
        F.count(error).alias("rows"),
        F.sum(error * error).alias("_sse"),
        (F.var_pop(F.when(both, actual)) * F.count(error)).alias("_sst"),
        F.avg(F.abs(error)).alias("mae"),
    )
    return stats.select(
        *by, "rows",
        (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"),
        "mae",
        F.sqrt(F.col("_sse") / F.col("rows")).alias("rmse"),
    )


def overfit_gap(df: DataFrame, train: str = "train_r2", val: str = "val_r2", into: str = "overfit_gap_r2") -> DataFrame:
    return df.withColumn(into, col(train) - col(val))
