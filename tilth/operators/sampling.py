"""Exact samples, splits and folds by the order of a seeded hash of the row key.

Rows are never sorted.  The hash values are counted by their leading digits (a small
table, combined on the map side), the digits that hold a wanted position are counted
once more by full hash, and the result is one cut hash per stratum and position.
Labelling the rows is then a comparison with those cuts: no shuffle of the data, and a
stratum that holds a third of all rows is as cheap as any other.

Rows with equal keys share a hash.  When a cut falls among them, those rows alone are cut
in the same way by a hash of all their columns, so which rows are taken does not depend on
how they are stored.  Rows equal in every column are interchangeable; when a cut falls even
among those, they are checkpointed and numbered within their partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilth.functions.columns import col, hash_number, seeded_hash, unused
from tilth.session import MAX_SMALL_ROWS, gather_small, one_row, reliable

DIGITS = 3  # hex digits counted at a time: 4096 bins per stratum
HASH_LENGTH = 32
MAX_HASHES = 1_000_000  # different hashes that one task ranks
#: Columns made on the way; a given column of such a name is called otherwise meanwhile.
OWN = "_all _before _bin _c _cuts _d _hash _key_hash _local _mid _more _next _nth _pid _rank _size _upto".split()


def _match(left: str, right: str, keys: Sequence[str]):
    return [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys]


def _bins(rows: DataFrame, strata: Sequence[str], digits: int) -> DataFrame:
    counted = rows.groupBy(*strata, F.substring("_hash", 1, digits).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    return gather_small(counted)[0]


def _near(rows: DataFrame, hit: DataFrame, strata: Sequence[str], digits: int) -> DataFrame:
    """The rows in the bins that hold a wanted position, with their bin."""
    homes = hit.select(*strata, "_bin").distinct()
    slim = rows.select(*strata, "_hash", F.substring("_hash", 1, digits).alias("_bin"))
    return slim.alias("r").join(homes.alias("h"), _match("r", "h", [*strata, "_bin"]), "left_semi")


def _narrowed(rows: DataFrame, hit: DataFrame, strata: Sequence[str], digits: int) -> DataFrame:
    """Wanted positions with their bins cut by further digits.  The size of a bin is its
    number of different hashes, as copies of a hash are ranked as one."""
    deeper = (
        _near(rows, hit, strata, digits)
        .groupBy(*strata, "_bin", F.substring("_hash", 1, digits + DIGITS).alias("_next"))
        .agg(F.count(F.lit(1)).alias("_c"), F.approx_count_distinct("_hash").alias("_d"))
    )
    upto = Window.partitionBy(*strata, "_bin").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
    running = deeper.withColumn("_upto", F.sum("_c").over(upto))
    found = (
        hit.alias("t")
        .join(running.alias("b"), _match("t", "b", [*strata, "_bin"]))
        .where((F.col("_rank") > F.col("_upto") - F.col("_c")) & (F.col("_rank") <= F.col("_upto")))
        .select(
            *[F.col(f"t.`{k}`").alias(k) for k in strata],
            "cut", F.col("_next").alias("_bin"),
            (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"),
            F.least("_c", "_d").alias("_size"),
        )
    )
    return gather_small(found)[0]


def _cuts(
    rows: DataFrame, bins: DataFrame, targets: DataFrame, strata: Sequence[str], digits: int, max_hashes: int
) -> DataFrame:
    """Targets (strata, cut, pos) -> (strata, cut, cut_hash, take, tied): the hash at that
    position of the stratum and how many of the rows that carry it lie up to it.

    A bin with more hashes than one task should rank is narrowed digit by digit first.
    """
    upto = Window.partitionBy(*strata).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    running = bins.withColumn("_upto", F.sum("_c").over(upto))
    inner = targets.where(F.col("pos") > 0)
    hit = (
        inner.alias("t")
        .join(running.alias("b"), _match("t", "b", strata))
        .where((F.col("pos") > F.col("_upto") - F.col("_c")) & (F.col("pos") <= F.col("_upto")))
        .select(
            *[F.col(f"t.`{k}`").alias(k) for k in strata],
            "cut", "_bin", (F.col("pos") - F.col("_upto") + F.col("_c")).alias("_rank"),
            F.col("_c").alias("_size"),
        )
    )
    hit, _ = gather_small(hit)
    while digits < HASH_LENGTH and (one_row(hit.agg(F.max("_size").alias("m")))["m"] or 0) > max_hashes:
        hit = _narrowed(rows, hit, strata, digits)
        digits += DIGITS
    hashes = _near(rows, hit, strata, digits).groupBy(*strata, "_bin", "_hash").agg(F.count(F.lit(1)).alias("tied"))
    order = Window.partitionBy(*strata, "_bin").orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hashes.withColumn("_upto", F.sum("tied").over(order))
    found = (
        hit.alias("t")
        .join(ranked.alias("r"), _match("t", "r", [*strata, "_bin"]))
        .where((F.col("_rank") > F.col("_upto") - F.col("tied")) & (F.col("_rank") <= F.col("_upto")))
        .select(
            *[F.col(f"t.`{k}`").alias(k) for k in strata],
            "cut", F.col("_hash").alias("cut_hash"),
            (F.col("_rank") - F.col("_upto") + F.col("tied")).alias("take"), "tied",
        )
    )
    nothing = targets.where(F.col("pos") <= 0).select(
        *strata, "cut", F.lit("").alias("cut_hash"),
        F.lit(0).cast("bigint").alias("take"), F.lit(0).cast("bigint").alias("tied"),
    )
    return found.unionByName(nothing)


def _numbered(tied: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number rows of equal key 1..n, in the order in which a checkpoint stores them.
    A window holds the rows of one key in one stored partition."""
    stored = reliable(tied).withColumns(
        {"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}
    )
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy(*keys, "_pid")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .drop("_c")
    )
    within = Window.partitionBy(*keys, "_pid").orderBy("_mid")
    local = stored.withColumn("_local", F.row_number().over(within))
    names = [*keys, "_pid"]
    joined = local.alias("l").join(offsets.alias("o"), _match("l", "o", names))
    return joined.select("l.*", "_before").withColumn("_nth", F.col("_before") + F.col("_local")).drop(
        "_before", "_local", "_pid", "_mid"
    )


def _parts(hashed: DataFrame, keys: Sequence[str], targets, into: str, digits: int, max_hashes: int, last: bool) -> DataFrame:
    """Add ``into``, the number of cuts a row (its keys and ``_hash``) lies beyond.

    ``last`` says that rows of one hash are equal, so that any of them may be taken.
    """
    slim = hashed.select(*keys, "_hash")
    bins = _bins(slim, keys, digits)
    sizes = bins.groupBy(*keys).agg(F.sum("_c").alias("size"))
    cuts = _cuts(slim, bins, targets(sizes, keys), keys, digits, max_hashes)
    packed = cuts.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("cut", "cut_hash", "take", "tied"))).alias("_cuts")
    )
    packed, rows = gather_small(packed)
    joined = hashed.alias("d").join(packed.alias("c"), _match("d", "c", keys))
    joined = joined.select("d.*", "_cuts")
    broken = lambda c: (F.col("_hash") == c["cut_hash"]) & (c["take"] < c["tied"])
    past = lambda c: F.col("_hash") > c["cut_hash"]
    has_ties = rows is None or any(c["take"] < c["tied"] for r in rows for c in r["_cuts"])
    part = F.size(F.filter("_cuts", past)).alias(into)
    if not has_ties:
        return joined.withColumn(into, part).drop("_cuts")
    clear = joined.where(~F.exists("_cuts", broken)).withColumn(into, part).drop("_cuts")
    tied = joined.where(F.exists("_cuts", broken))
    if last:
        tied = _numbered(tied, [*keys, "_hash"])
        beyond = lambda c: past(c) | ((F.col("_hash") == c["cut_hash"]) & (F.col("_nth") > c["take"]))
        tied = tied.withColumn(into, F.size(F.filter("_cuts", beyond))).drop("_cuts", "_nth")
        return clear.unionByName(tied)
    own = [c for c in hashed.columns if c not in (*keys, "_hash")]
    again = tied.withColumn(into, part).drop("_cuts").withColumnRenamed("_hash", "_key_hash")
    again = again.withColumn("_hash", F.md5(F.to_json(F.struct(*[col(c) for c in own]))))
    inner = cuts.where(F.col("take") < F.col("tied")).select(
        *keys, F.col("cut_hash").alias("_key_hash"), "cut", F.col("take").alias("pos"))
    inner, _ = gather_small(inner)
    more = _parts(again, [*keys, "_key_hash"], lambda sizes, _: inner, "_more", digits, max_hashes, True)
    more = more.withColumn(into, F.col(into) + F.col("_more")).drop("_more", "_hash").withColumnRenamed("_key_hash", "_hash")
    return clear.unionByName(more)


def split_at(
    df: DataFrame,
    key: Sequence[str],
    seed: int,
    targets,
    strata: Sequence[str] = (),
    into: str = "part",
    digits: int | None = None,
    max_hashes: int = MAX_HASHES,
) -> DataFrame:
    """Number the parts 0, 1, ... into which cumulative positions cut each stratum.

    ``targets`` maps the table of stratum sizes (strata, size) to (strata, cut, pos) with
    positions ascending in ``cut``.  Without ``digits`` as many leading digits are counted as
    keep the bins of all strata within the bound of what is gathered.
    """
    clashing = {c: unused(f"{c}_given", df.columns) for c in df.columns if c.lower() in OWN}
    if clashing:
        named = [[clashing.get(c, c) for c in names] for names in (key, strata)]
        renamed = split_at(df.withColumnsRenamed(clashing), named[0], seed, targets, named[1], into, digits, max_hashes)
        return renamed.withColumnsRenamed({v: k for k, v in clashing.items()})
    strata = list(strata)
    keys = strata or ["_all"]
    if digits is None:
        many = one_row(df.select(*[col(s) for s in strata]).agg(F.approx_count_distinct(F.struct(*[col(s) for s in strata])).alias("n")))["n"] if strata else 1
        digits = next((d for d in range(DIGITS, 1, -1) if 1.1 * many * 16**d <= MAX_SMALL_ROWS), 1)
    hashed = df.withColumn("_hash", seeded_hash(key, seed))
    if not strata:
        hashed = hashed.withColumn("_all", F.lit(0))
    done = _parts(hashed, keys, targets, into, digits, max_hashes, False)
    return done.drop("_hash") if strata else done.drop("_hash", "_all")


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows without replacement (all rows when there are fewer)."""

    def targets(sizes, keys):
        return sizes.select(*keys, F.lit(0).alias("cut"), F.least("size", F.lit(n)).alias("pos"))

    part = unused("_part", df.columns)
    return split_at(df, key, seed, targets, into=part).where(F.col(part) == 0).drop(part)


def stratified_sample(
    df: DataFrame, strata: Sequence[str], total: int, key: Sequence[str], seed: int = 42
) -> DataFrame:
    """min(size, total // number of strata) rows of every stratum; NULL strata are left out."""
    known = df.na.drop(subset=list(strata))

    def targets(sizes, keys):
        quota = F.floor(F.lit(total) / sizes.agg(F.count(F.lit(1))).scalar())
        return sizes.select(*keys, F.lit(0).alias("cut"), F.least("size", quota).alias("pos"))

    part = unused("_part", df.columns)
    return split_at(known, key, seed, targets, strata, into=part).where(F.col(part) == 0).drop(part)


def _shares(sizes: DataFrame, keys: Sequence[str], size: str, keep: int, into: str) -> DataFrame:
    """Spread ``keep`` rows over the strata in proportion to their size: whole parts
    first, what is left one each to the largest remainders (ties by stratum)."""
    total = one_row(sizes.agg(F.sum(size).alias("n")))["n"] or 0
    if not total:
        return sizes.withColumn(into, F.lit(0).cast("bigint"))
    exact = F.col(size).cast("decimal(19,0)") * F.lit(int(keep)).cast("decimal(19,0)")
    whole = F.floor(exact / F.lit(int(total)).cast("decimal(19,0)"))
    base = sizes.withColumn(into, whole.cast("bigint")).withColumn(
        "_rest", exact - F.col(into).cast("decimal(19,0)") * F.lit(int(total)).cast("decimal(19,0)")
    )
    spare = keep - one_row(base.agg(F.sum(into).alias("n")))["n"]
    # one row per stratum, not per data row
    lucky = base.orderBy(F.col("_rest").desc(), *[col(k) for k in keys]).limit(spare).select(
        *keys, F.lit(1).alias("_more")
    )
    joined = base.alias("s").join(lucky.alias("m"), _match("s", "m", keys), "left")
    return joined.select("s.*", "_more").withColumn(
        into, F.col(into) + F.coalesce("_more", F.lit(0))
    ).drop("_rest", "_more")


def stratified_split(
    df: DataFrame,
    strata: Sequence[str],
    key: Sequence[str],
    test: float = 0.15,
    val: float = 0.1765,
    seed: int = 42,
    into: str = "split",
) -> DataFrame:
    """Label rows 'test', 'val' or 'train': first ceil(test * n) rows for the test part,
    then ceil(val * rest) for validation, every stratum in its share."""

    def targets(sizes, keys):
        sizes, _ = gather_small(sizes)
        n = one_row(sizes.agg(F.sum("size").alias("n")))["n"] or 0
        rest = n - math.ceil(n * test)
        kept = _shares(sizes, keys, "size", rest, "_rest_n")
        train = rest - math.ceil(rest * val)
        final = _shares(kept, keys, "_rest_n", train, "_train_n")
        cuts = F.array(
            F.struct(F.lit(0).alias("cut"), (F.col("size") - F.col("_rest_n")).alias("pos")),
            F.struct(F.lit(1).alias("cut"), (F.col("size") - F.col("_train_n")).alias("pos")),
        )
        return final.select(*keys, F.inline(cuts))

    part = unused("_part", [*df.columns, into])
    parts = split_at(df, key, seed, targets, strata, into=part)
    names = F.array(F.lit("test"), F.lit("val"), F.lit("train"))
    return parts.withColumn(into, names[F.col(part)]).drop(part)


def random_split(
    df: DataFrame, test: float, key: Sequence[str], seed: int = 42, exact: bool = True, into: str = "split"
) -> DataFrame:
    """Label ceil(test * n) rows 'test', the others 'train'.  Not exact, the label is a
    hash threshold: one narrow pass, sizes equal to the share only on average."""
    if not exact:
        limit = F.lit(test * 2.0**32)
        inside = hash_number(seeded_hash(key, seed)).cast("double") < limit
        return df.withColumn(into, F.when(inside, "test").otherwise("train"))

    def targets(sizes, keys):
        return sizes.select(*keys, F.lit(0).alias("cut"), F.ceil(F.col("size") * F.lit(test)).alias("pos"))

    part = unused("_part", [*df.columns, into])
    parts = split_at(df, key, seed, targets, into=part)
    return parts.withColumn(into, F.when(F.col(part) == 0, "test").otherwise("train")).drop(part)


def assign_folds(
    df: DataFrame, k: int, key: Sequence[str], seed: int = 42, exact: bool = False, into: str = "fold"
) -> DataFrame:
    """Fold 0..k-1 of every row.  By default a hash remainder (no shuffle, sizes nearly
    equal); exact folds differ by at most one row, the first ones being the larger."""
    if not exact:
        return df.withColumn(into, F.pmod(hash_number(seeded_hash(key, seed)), F.lit(k)).cast("int"))

    def targets(sizes, keys):
        cuts = F.array(
            *[
                F.struct(
                    F.lit(i).alias("cut"),
                    (F.expr(f"size div {k}") * (i + 1) + F.least(F.col("size") % k, F.lit(i + 1))).alias("pos"),
                )
                for i in range(k - 1)
            ]
        )
        return sizes.select(*keys, F.inline(cuts))

    return split_at(df, key, seed, targets, into=into)
