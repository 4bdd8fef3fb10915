"""Top-k, ranking and running totals without a global sort into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilth.functions.columns import col, unused
from tilth.session import MAX_SMALL_ROWS, staged


def top_k_groups(df: DataFrame, keys: Sequence[str], name: str, k: int) -> DataFrame:
    """The k groups with the largest sum, ties by key order."""
    return (
        df.na.drop(subset=list(keys))
        .groupBy(*keys)
        .agg(F.sum(col(name)).alias("total"))
        .orderBy(F.col("total").desc_nulls_last(), *[col(c) for c in keys])
        .limit(k)
    )


def rank_candidates(df: DataFrame, ids: Sequence[str], score: str, position: str, into: str = "rank") -> DataFrame:
    """1..n per id by descending score without gaps, ties in the candidates' order.

    A window holds the candidates of one id, as many as the vocabulary has entries.
    """
    order = Window.partitionBy(*ids).orderBy(col(score).desc_nulls_last(), col(position))
    return df.withColumn(into, F.row_number().over(order))


def running_start(base: Column, contributions: Column, field: str = "contribution") -> Column:
    """Waterfall over an array of structs: each bar starts where the earlier ones end.
    Works inside the row, so it needs no shuffle."""

    def bar(item: Column, i: Column) -> Column:
        earlier = F.slice(contributions, F.lit(1), i)
        start = F.aggregate(earlier, base.cast("double"), lambda acc, e: acc + e[field])
        return F.struct(item["feature"].alias("feature"), start.alias("start"), item[field].alias("height"))

    return F.transform(contributions, bar)


def running_contributions(df: DataFrame, ids: Sequence[str], order: str, value: str, base: str) -> DataFrame:
    """The same waterfall for a long table with one row per id and bar."""
    earlier = Window.partitionBy(*ids).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = col(base) + F.coalesce(F.sum(col(value)).over(earlier), F.lit(0.0))
    return df.withColumn("start", start)


def cumulative_share(df: DataFrame, order: str, value: str, by: Sequence[str] = (), into: str = "cumulative") -> DataFrame:
    """Running total along an order, within groups or over the whole table.

    A NULL value adds nothing, and the total is NULL before the first value.
    """
    if not by:
        return prefix_sums(df, order, value, into)
    frame = Window.partitionBy(*[col(b) for b in by]).orderBy(col(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(into, F.sum(col(value)).over(frame))


def prefix_sums(df: DataFrame, order: str, value: str, into: str = "cumulative") -> DataFrame:
    """Running total over a whole table, in two levels and never in one task.

    Rows are written with a line number, dealt to ranges of (order, line) and written again
    with the number of their range; the totals of the ranges, one number each, become offsets
    on the driver; inside a range a window adds up its rows.  The line number parts rows of
    equal order, so a value that a third of the rows share fills several ranges; such rows
    follow each other in the order in which they were written.
    """
    kept = [c for c in df.columns if c.lower() != into.lower()]
    line, part = unused("line", df.columns), unused("part", df.columns)
    lined = staged(df.withColumn(line, F.monotonically_increasing_id()), "lines")
    ranged = lined.repartitionByRange(col(order), col(line)).withColumn(part, F.spark_partition_id())
    ranged = staged(ranged, "ranges")
    found = ranged.groupBy(part).agg(F.sum(col(value)).alias("total")).collect()  # a row a range
    offsets, upto = [], None
    for row in sorted(found, key=lambda r: r[part]):
        offsets.append((row[part], upto))
        if row["total"] is not None:
            upto = row["total"] if upto is None else upto + row["total"]
    kind = ranged.agg(F.sum(col(value)).alias("total")).schema["total"].dataType.simpleString()
    table = df.sparkSession.createDataFrame(offsets, f"`{part}` int, before {kind}")
    frame = Window.partitionBy(part).orderBy(col(order), col(line)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.select("*", F.sum(col(value)).over(frame).alias(inner := unused("inside", [*df.columns, line, part])))
    before = unused("before", inside.columns)
    joined = inside.join(F.broadcast(table.withColumnRenamed("before", before)), part)
    total = F.coalesce(F.col(before) + F.col(inner), F.col(inner), F.col(before))
    return joined.select(*[col(c) for c in kept], total.alias(into))


def sort_by_magnitude(df: DataFrame, name: str, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.abs(col(name)).desc_nulls_last(), *[col(t) for t in ties])


def without_top(df: DataFrame, score: str, keys: Sequence[str], k: int) -> DataFrame:
    """All rows but the k largest, ties by ``keys`` (which name a row).

    The k rows come from per-task top-k lists and are taken out by an anti join, by
    broadcast where k is small.
    """
    top = df.orderBy(col(score).desc_nulls_last(), *[col(c) for c in keys]).limit(k).select(*keys)
    return df.join(F.broadcast(top) if k <= MAX_SMALL_ROWS else top, list(keys), "left_anti")


def best_of(df: DataFrame, by: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """Best row per group; among equal scores the first in the order of ``ties`` wins.

    Spark limits each group to its first row before the shuffle, so a task sends one row
    a group, whatever the size of the group.
    """
    order = Window.partitionBy(*[col(b) for b in by]).orderBy(col(score).cast("double").desc(), *[col(t) for t in ties])
    ranked = df.where(col(score).isNotNull()).withColumn("_line", F.row_number().over(order))
    return ranked.where("_line = 1").select(*[col(b) for b in by], *[col(c) for c in df.columns if c not in by])
