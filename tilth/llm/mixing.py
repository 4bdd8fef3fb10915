"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, the source's target over its
size.  The documents of a source stand in the order of their sizes; the running sum of
expected copies, moved by one random offset, crosses integers, and a document is taken once
for every integer it crosses.  Because neighbours have like sizes, the words taken differ
from the target by less than the source's largest document; of ``TRIES`` offsets, evenly
spaced from the random one, a source uses that whose words come nearest its target.

The running sum of equal shares is a multiple of the document's place in its source, which
comes from the rows' global places: no task ever holds a source.  A document's upper end
and its successor's lower end are the same expression, so rounding cannot lose a copy.

Defined results: null texts have size 0; the null source is a source and stands last; a
source without words has target 0 and none of it is taken; repeated rows are rows of their
own; an empty table gives an empty mix; extra columns of any name are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tilth.llm.base import positioned
from tilth.session import staged

WEIGHTS = (5, 2, 1)
#: A source may be repeated so many times at most.
MOST_REPEATS = 3
#: Offsets looked at for each source.
TRIES = 64


def word_count(text: str) -> Column:
    """Number of runs without space, tab, line feed, vertical tab, form feed or carriage return."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from one row per source.

    All words are shared by weight; what a source cannot take (over ``repeats`` times its
    size) is shared again by weight.  Sorted by size over weight, the sources that stop are
    the first ones, so the level at which the rest stands follows from two running sums.
    """
    line = Window.orderBy(F.col("source").asc_nulls_last())
    by_place = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.withColumn("__place", F.row_number().over(line) - 1)
    named = named.withColumn("__weight", F.element_at(by_place, (F.col("__place") % len(weights) + 1).cast("int")))
    named = named.withColumn("__cap", F.col("source_size").cast("double") * repeats)
    every = Window.orderBy(F.col("__cap") / F.col("__weight"), "__place")
    upto = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(upto), F.lit(0.0))
    weight = F.sum("__weight").over(every.rowsBetween(0, Window.unboundedFollowing))
    levelled = named.withColumn("__level", rest / weight)
    free = F.col("__level") * F.col("__weight") <= F.col("__cap")
    first = F.min(F.when(free, F.struct(F.col("__cap") / F.col("__weight"), "__place", "__level"))).over(whole)
    level = levelled.select("source", "source_size", "__weight", "__cap", first["__level"].alias("__level"))
    share = F.least("__cap", F.coalesce(F.col("__level"), F.lit(0.0)) * F.col("__weight"))
    return level.select("source", "source_size", F.when(F.col("source_size") > 0, share).otherwise(F.lit(0.0)).alias("target"))


def _crossed(place: Column, share: Column, start: Column, repeats: int) -> Column:
    """Integers that the running sum of shares crosses at a place."""
    return F.least(F.floor((place + 1) * share + start) - F.floor(place * share + start), F.lit(repeats))


def offset(seed: int, source: Column) -> Column:
    """The random offset of a source in [0, 1), the same in every run: 24 bits of an md5."""
    named = F.concat(F.lit(f"{seed}/"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 6), 16, 10).cast("double") / F.lit(float(1 << 24))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = MOST_REPEATS, seed: int = 0,
         key: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """(row, size, source_size, target, copies, taken) of every document; ``row`` has the columns ``carry`` (default all)."""
    rows = docs.select(
        F.struct(*(docs.columns if carry is None else carry)).alias("__row"), F.col(source).alias("__source"), F.col(key).alias("__key"), word_count(text).alias("size")
    )
    order = [F.col("__source").asc_nulls_last(), F.col("size"), F.col("__key").asc_nulls_last(), F.xxhash64("__row")]
    placed = positioned(rows, order, "__place", "mix", 4 if carry is None else 1)
    sources = placed.groupBy(F.col("__source").alias("source")).agg(
        F.sum("size").alias("source_size"), F.min("__place").alias("__first")
    )
    sources = staged(sources, "mix-sources")
    wanted = targets(sources.select("source", "source_size"), weights, repeats)
    wanted = wanted.join(sources.select(F.col("source").alias("s"), "__first"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    wanted = wanted.withColumn(
        "__share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ).withColumn("__start", offset(seed, F.col("source")))
    joined = placed.join(wanted, F.col("__source").eqNullSafe(F.col("source")))
    place, share = F.col("__place") - F.col("__first"), F.col("__share")
    starts = [(F.col("__start") + F.lit(j / TRIES)) % F.lit(1.0) for j in range(TRIES)]
    words = [F.sum(_crossed(place, share, u, repeats) * F.col("size")).alias(f"w{j}") for j, u in enumerate(starts)]
    tried = joined.groupBy("source", "target", "__start").agg(*words)
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{j}") - F.col("target")).alias("off"), F.lit(j).alias("j")) for j in range(TRIES)]))
    chosen = staged(tried.select("source", nearest["j"].alias("__try")), "mix-offsets")
    chosen = wanted.join(chosen.select(F.col("source").alias("s"), "__try"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    start = (F.col("__start") + F.col("__try") / F.lit(float(TRIES))) % F.lit(1.0)
    return (
        placed.join(chosen, F.col("__source").eqNullSafe(F.col("source")))
        .withColumn("copies", _crossed(place, share, start, repeats).cast("int"))
        .select(F.col("__row").alias("row"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as it was taken."""
    planned = plan(docs, **options).where("copies > 0")
    return planned.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
