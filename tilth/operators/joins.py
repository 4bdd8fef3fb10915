"""Joins between fact tables, and enrichment of a fact table by a profile.

Two large sides are joined by key and left to Catalyst; a hot key is split by AQE's
skew join.  A profile is gathered under a checked bound before it is broadcast and is
joined by shuffle beyond that bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.functions.columns import col
from tilth.session import MAX_SMALL_ROWS, gather_small


def join_sources(first: DataFrame, *others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-joins on shared keys, one after the other.  All joins use the same
    keys, so one partitioning of the left side serves the whole chain; several rows per
    key on a side multiply, as in any relational join."""
    joined = first
    for other in others:
        joined = joined.join(other, list(keys), "inner")
    return joined


def fanout_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How an inner join would multiply: largest group on each side, matched keys and
    the joined row count, from per-key counts alone (no hot group is brought together)."""
    k = list(keys)
    a = left.groupBy(*k).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(*k).agg(F.count(F.lit(1)).alias("_b"))
    return a.join(b, k, "inner").agg(
        F.count(F.lit(1)).alias("matched_keys"),
        F.coalesce(F.max("_a"), F.lit(0)).alias("max_left_rows"),
        F.coalesce(F.max("_b"), F.lit(0)).alias("max_right_rows"),
        F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("joined_rows"),
    )


def enrich_left(
    fact: DataFrame, profile: DataFrame, key: str | Sequence[str], max_rows: int = MAX_SMALL_ROWS
) -> DataFrame:
    """Left join of a profile that has one row per key, so the fact rows stay as many.

    The promise is checked on the profile, which is small, instead of counting the fact
    table before and after.
    """
    keys = [key] if isinstance(key, str) else list(key)
    side, _ = gather_small(profile, max_rows)
    repeated = side.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if repeated:
        raise ValueError(f"profile has several rows for one key: {repeated[0].asDict()}")
    return fact.join(side, keys, "left")


def unmatched_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct non-NULL keys of the left table without a partner."""
    have = left.select(col(key)).where(col(key).isNotNull()).distinct()
    return have.join(right.select(col(key)).distinct(), key, "left_anti")


def matched_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(col(key)).distinct(), key, "left_semi")


def expand_candidates(contexts: DataFrame, candidates: Sequence, into: str, position: str | None = None) -> DataFrame:
    """Every context with every candidate of a fixed vocabulary: a generator inside the
    scanning task, neither a join nor a shuffle."""
    items = F.array(*[F.lit(c) for c in candidates])
    rest = [col(c) for c in contexts.columns if c != into]
    if position:
        return contexts.select(*rest, F.posexplode(items).alias(position, into))
    return contexts.select(*rest, F.explode(items).alias(into))


def coverage(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with a value, overall or per group."""
    share: Column = F.avg(col(name).isNotNull().cast("double")).alias("coverage")
    rows = F.count(F.lit(1)).alias("rows")
    return df.groupBy(*by).agg(rows, share) if by else df.agg(rows, share)


def common_values(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def only_in_first(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def stack_results(tables: Sequence[DataFrame]) -> DataFrame:
    """Result tables under each other by column name; absent columns become NULL."""
    if not tables:
        raise ValueError("no tables to stack")
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table, allowMissingColumns=True)
    return stacked
