"""Projections, predicates and cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.functions.columns import col


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by exact name; a name with a leading space is matched as it is."""
    return df.withColumnsRenamed(dict(names))


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop the columns; a name may be listed twice."""
    return df.drop(*dict.fromkeys(names))


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[col(n) for n in names])


def filter_valid(df: DataFrame, name: str, lowest: float = 0.0) -> DataFrame:
    """Keep rows at or above ``lowest``; NULL fails the test too."""
    return df.where(col(name) >= F.lit(lowest))


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def coerce_numeric(df: DataFrame, name: str) -> DataFrame:
    """Text to double; text that is no number becomes NULL, also under ANSI mode."""
    return df.withColumn(name, F.trim(col(name).cast("string")).try_cast("double"))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def copies(df: DataFrame, name: str = "copies") -> DataFrame:
    """Distinct rows with their multiplicity; copies are merged before the shuffle."""
    return df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias(name))


def count_duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row."""
    return copies(df, "_n").agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")
    )


def list_duplicates(
    df: DataFrame, order: Sequence[str] | None = None, n: int | None = None, chunk: int = 100_000
) -> DataFrame:
    """Every member of a duplicate group; with ``n`` the first n in the given order.

    Members of a group are equal, so a group travels as one row with a count and is
    written out again at the end.  A group of more than ``chunk`` copies is written
    out by several tasks.
    """
    names = df.columns
    groups = copies(df, "_n").where(F.col("_n") > 1)
    ordering = [col(c) for c in [*(order or []), *[c for c in names if c not in (order or [])]]]
    if n is not None:
        # n groups hold at least the first n members
        groups = groups.orderBy(*ordering).limit(n).withColumn("_n", F.least("_n", F.lit(n)))
    pieces = groups.withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {int(chunk)}")))
    )
    if n is None:
        pieces = pieces.repartition(*[col(c) for c in names], F.col("_piece"))
    size = F.least(F.lit(chunk).cast("bigint"), F.col("_n") - F.col("_piece") * chunk)
    out = pieces.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
    out = out.select(*[col(c) for c in names])
    return out.orderBy(*ordering).limit(n) if n is not None else out


def missing_profile(df: DataFrame) -> DataFrame:
    """NULL count of every column, one pass and one small row turned long."""
    counts = df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), col(c).alias("missing")) for c in df.columns]
    )
    return counts.select(F.inline(pairs))


def scale_unit(df: DataFrame, name: str, factor: float, into: str | None = None) -> DataFrame:
    return df.withColumn(into or name, col(name) / F.lit(float(factor)))


def map_values(df: DataFrame, name: str, mapping: Mapping, into: str | None = None) -> DataFrame:
    """Dictionary lookup; values that are unlisted or mapped to None become NULL.

    The mapping is code, not data: a literal map serves a short vocabulary; a long one
    becomes a small table joined by broadcast.
    """
    known = {k: v for k, v in mapping.items() if v is not None}
    into = into or name
    if not known:
        return df.withColumn(into, F.lit(None).cast("string"))
    if len(known) <= 200:
        table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        return df.withColumn(into, table[col(name)])
    lookup = df.sparkSession.createDataFrame(list(known.items()), ["_from", "_to"])
    # a local relation: Spark knows its size and picks the join by it
    joined = df.join(lookup, col(name) == F.col("_from"), "left")
    return joined.withColumn(into, F.col("_to")).drop("_from", "_to")


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({name: col(name).cast(kind) for name, kind in types.items()})


def filter_in(df: DataFrame, name: str, values: Sequence, negate: bool = False) -> DataFrame:
    """Membership filter.  Negated, a NULL stays: it is in no list."""
    inside = col(name).isin(list(values))
    return df.where(~F.coalesce(inside, F.lit(False))) if negate else df.where(inside)


def filter_contains(df: DataFrame, name: str, text: str) -> DataFrame:
    return df.where(col(name).contains(text))


def round_columns(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    return df.withColumns({name: F.round(col(name), d) for name, d in digits.items()})


def preview(df: DataFrame, n: int, order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """First (or last) n rows under an explicit order, ties by the other columns."""
    keys = [c if isinstance(c, Column) else col(c) for c in order]
    keys += [col(c) for c in df.columns if c not in order]
    if last:
        return df.orderBy(*[k.desc() for k in keys]).limit(n).orderBy(*keys)
    return df.orderBy(*keys).limit(n)


def schema_profile(df: DataFrame) -> DataFrame:
    """Column list with type, non-NULL count and total row count."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(col(c)).alias(c) for c in df.columns]
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("data_type"),
            col(name).alias("non_missing"),
            F.col("_rows").alias("total_rows"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*entries)))


def any_missing(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [col(n).isNull() for n in names])
