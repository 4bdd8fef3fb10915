"""Exact quantiles with linear interpolation, for groups of any size.

Values are counted first and ``percentile`` ranks the counts of a group in one task.  That
is the right plan while a group has few distinct values.  Groups with more go through a
selection by refinement: the value range is cut into equal bins, the bins are counted
with map-side combine, and only the bin holding the wanted rank is looked at again.
Each pass reads the column once and shuffles bin counts, never the values, until the
remaining bin is small enough to rank its distinct values exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilth.functions.columns import col
from tilth.session import gather_small, one_row

MAX_STATES = 1_000_000
BINS = 65_536
# Passes narrow a bracket by a factor of BINS each; what is left after the last one is
# ranked by distinct value whatever its size, so the result does not depend on it.
MAX_PASSES = 8


def distinct_states(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> dict[str, int]:
    """Largest (approximate) number of distinct values any group has, per column."""
    per_group = [F.approx_count_distinct(col(n)).alias(f"_d{i}") for i, n in enumerate(names)]
    sizes = df.groupBy(*by).agg(*per_group) if by else df.agg(*per_group)
    top = one_row(sizes.agg(*[F.max(f"_d{i}").alias(f"_d{i}") for i in range(len(names))]))
    return {n: int(top[f"_d{i}"] or 0) for i, n in enumerate(names)}


def quantiles(
    df: DataFrame,
    name: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    into: str = "quantiles",
    max_states: int = MAX_STATES,
    bins: int = BINS,
) -> DataFrame:
    """One row per group: the keys and an array with the exact quantile of each prob."""
    by = list(by)
    value = col(name).cast("double")
    levels = F.array(*[F.lit(float(p)) for p in probs])
    if not by:
        if distinct_states(df, [name])[name] <= max_states:
            return _counted(df, value, by, levels, into)
        return _refined(df.withColumn("_all", F.lit(0)), value, probs, ["_all"], into, max_states, bins).drop("_all")
    big = (
        df.groupBy(*by)
        .agg(F.approx_count_distinct(value).alias("_d"))
        .where(F.col("_d") > max_states)
        .select(*by)
    )
    big, rows = gather_small(big)
    if rows is not None and not rows:
        return _counted(df, value, by, levels, into)
    same = _null_safe(df, big, by)
    small_part = _counted(df.join(big, same, "left_anti"), value, by, levels, into)
    big_part = _refined(df.join(big, same, "left_semi"), value, probs, by, into, max_states, bins)
    return small_part.unionByName(big_part)


def _counted(df: DataFrame, value, by: Sequence[str], levels, into: str) -> DataFrame:
    """Values are counted first, so the task of a group gets each value once, not from every task."""
    counts = df.groupBy(*[col(k).alias(k) for k in by], value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*[col(k) for k in by]).agg(F.percentile("_v", levels, F.col("_c")).alias(into))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[f"`{k}`"].eqNullSafe(right[f"`{k}`"])
    return condition


def _refined(df, value, probs, by, into, max_states, bins) -> DataFrame:
    """Selection by refinement for the order statistics around every prob.

    ``brackets`` has one row per group and wanted rank: the closed value interval
    [lo, hi] that holds it, its rank within the interval and the rows in it.
    """
    data = df.select(*[col(k) for k in by], value.alias("_v")).where(F.col("_v").isNotNull())
    spans = data.groupBy(*by).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(2 * i + up).alias("_slot"),
                (rank((F.col("_n") - 1) * F.lit(float(p))).cast("bigint") + 1).alias("_rank"),
            )
            for i, p in enumerate(probs)
            for up, rank in ((0, F.floor), (1, F.ceil))
        ]
    )
    first = spans.select(*by, "_n", "_lo", "_hi", F.inline(wanted))
    brackets, _ = gather_small(first)
    order = Window.partitionBy(*by, "_lo", "_hi").orderBy("_bin")
    is_open = (F.col("_lo") < F.col("_hi")) & (F.col("_n") > max_states)
    for _ in range(MAX_PASSES):
        open_part = brackets.where(is_open)
        if open_part.isEmpty():
            break
        counted = _in_brackets(data, open_part, by)
        width = (F.col("_hi") / bins - F.col("_lo") / bins)
        place = F.floor((F.col("_v") - F.col("_lo")) / width)
        place = F.when(width > 0, F.least(place, F.lit(bins - 1))).otherwise(F.lit(0))
        cells = (
            counted.withColumn("_bin", place)
            .groupBy(*by, "_lo", "_hi", "_bin")
            .agg(F.count("_v").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
            .withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        )
        keys = [*by, "_lo", "_hi"]
        narrowed = (
            open_part.alias("b")
            .join(cells.alias("c"), [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
            .where((F.col("_rank") > F.col("_upto") - F.col("_c")) & (F.col("_rank") <= F.col("_upto")))
            .select(
                *[F.col(f"b.{k}").alias(k) for k in by],
                F.col("_c").alias("_n"), F.col("_min").alias("_lo"), F.col("_max").alias("_hi"),
                "_slot", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"),
            )
        )
        done = brackets.where(~is_open)
        brackets, _ = gather_small(done.unionByName(narrowed))
    return _picked(data, brackets, probs, by, into)


def _in_brackets(data: DataFrame, brackets: DataFrame, by) -> DataFrame:
    """Rows of the data once per distinct bracket that holds them."""
    unique = brackets.groupBy(*by).agg(F.collect_set(F.struct("_lo", "_hi")).alias("_b"))
    unique, _ = gather_small(unique)
    joined = data.alias("d").join(
        unique.alias("u"), [F.col(f"d.{k}").eqNullSafe(F.col(f"u.{k}")) for k in by]
    )
    inside = F.filter("_b", lambda b: (F.col("_v") >= b["_lo"]) & (F.col("_v") <= b["_hi"]))
    return joined.select(*[F.col(f"d.{k}").alias(k) for k in by], "_v", F.inline(inside))


def _picked(data: DataFrame, brackets: DataFrame, probs, by, into) -> DataFrame:
    """Rank the distinct values of the last brackets and interpolate."""
    keys = [*by, "_lo", "_hi"]
    open_part = brackets.where(F.col("_lo") < F.col("_hi"))
    order = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        _in_brackets(data, open_part, by)
        .groupBy(*keys, "_v")
        .agg(F.count("_v").alias("_c"))
        .withColumn("_upto", F.sum("_c").over(order))
    )
    found = (
        open_part.alias("b")
        .join(ranked.alias("r"), [F.col(f"b.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
        .where((F.col("_rank") > F.col("_upto") - F.col("_c")) & (F.col("_rank") <= F.col("_upto")))
        .select(*[F.col(f"b.{k}").alias(k) for k in by], "_slot", "_v")
    )
    settled = brackets.where(F.col("_lo") == F.col("_hi")).select(*by, "_slot", F.col("_lo").alias("_v"))
    stats = settled.unionByName(found)
    counts = data.groupBy(*by).agg(F.count("_v").alias("_n"))
    wide = stats.groupBy(*by).agg(
        *[F.max(F.when(F.col("_slot") == s, F.col("_v"))).alias(f"_s{s}") for s in range(2 * len(probs))]
    )
    joined = wide.alias("w").join(
        counts.alias("c"), [F.col(f"w.{k}").eqNullSafe(F.col(f"c.{k}")) for k in by]
    )

    def between(i: int, p: float):
        place = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        return low + (high - low) * (place - F.floor(place))

    values = F.array(*[between(i, p) for i, p in enumerate(probs)])
    return joined.select(*[F.col(f"w.{k}").alias(k) for k in by], values.alias(into))


def quantile_list(df: DataFrame, name: str, probs: Sequence[float], **how) -> list[float]:
    """Quantiles of a whole column as numbers; NaN-free input assumed."""
    found = one_row(quantiles(df, name, probs, **how))["quantiles"]
    return [math.nan if v is None else v for v in found] if found else [math.nan] * len(probs)
