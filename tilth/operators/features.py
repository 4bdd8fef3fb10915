"""Encoding of features: indicator columns, imputation and Spark ML feature pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StringIndexer, TargetEncoder, VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilth.functions.columns import col, hash_number, seeded_hash
from tilth.operators.aggregates import distinct_values
from tilth.operators.gram import FeatureSpec
from tilth.operators.quantiles import quantiles
from tilth.operators.stats import moments
from tilth.session import gather_small, staged

MAX_LEVELS = 10_000


def vocabulary(df: DataFrame, names: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted levels per column, refused when they are too many to be a vocabulary."""
    _, rows = gather_small(distinct_values(df, names), max_levels)
    if rows is None:
        raise ValueError(f"more than {max_levels} levels in {list(names)}")
    return {n: sorted(r["value"] for r in rows if r["column_name"] == n) for n in names}


def _indicators(df: DataFrame, levels: dict[str, list[str]], skip: int) -> DataFrame:
    cells = {
        f"{n}_{v}": F.coalesce((col(n).cast("string") == v).cast("int"), F.lit(0))
        for n, values in levels.items()
        for v in values[skip:]
    }
    return df.withColumns(cells)


def one_hot(df: DataFrame, names: Sequence[str], levels: dict[str, list[str]] | None = None) -> DataFrame:
    """One indicator column per level, all levels kept; with given ``levels`` (those of
    the training rows) an unknown value is 0 everywhere."""
    return _indicators(df, levels or vocabulary(df, names), 0)


def dummies(df: DataFrame, names: Sequence[str], drop_first: bool = True) -> DataFrame:
    """Indicator columns replacing their source, without the first sorted level."""
    return _indicators(df, vocabulary(df, names), 1 if drop_first else 0).drop(*names)


def impute_median(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Optional: missing numerics replaced by the column's exact median."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), col(n).cast("double").alias("value")) for n in names])
    found = quantiles(df.select(F.inline(cells)), "value", [0.5], ["name"])
    medians = {r["name"]: r["quantiles"][0] for r in found.collect() if r["quantiles"]}  # a row per column
    return df.withColumns({n: F.coalesce(col(n).cast("double"), F.lit(medians.get(n)).cast("double")) for n in names})


def scaler(df: DataFrame, names: Sequence[str]) -> SQLTransformer:
    """Stage that adds ``<name>__z`` = (x - mean) / population deviation of this table."""
    cells = [
        f"(CAST(`{n}` AS DOUBLE) - ({m!r}D)) / ({s!r}D) AS `{n}__z`" for n, (m, s) in moments(df, names).items()
    ]
    return SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__")


def feature_stages(df: DataFrame, spec: FeatureSpec, kind: str, scale: bool) -> tuple[list, list[str], list[str]]:
    """Stages, assembled columns and their parent features.

    kind 'one_hot': all levels as indicators, unknown levels all zero (the extra slot the
    indexer keeps for them is the one the encoder drops).  kind 'native': level indices
    with nominal metadata, which tree learners split as sets.  kind 'target': mean target
    per level with smoothing, learnt from the rows the pipeline is fitted on.
    """
    stages, cols, parents = [], [], []
    if spec.numerics:
        if scale:
            stages.append(scaler(df, spec.numerics))
            cols += [f"{n}__z" for n in spec.numerics]
        else:
            cols += list(spec.numerics)
        parents += list(spec.numerics)
    if spec.booleans:
        cells = ", ".join(f"CAST(`{b}` AS DOUBLE) AS `{b}__b`" for b in spec.booleans)
        stages.append(SQLTransformer(statement=f"SELECT *, {cells} FROM __THIS__"))
        cols += [f"{b}__b" for b in spec.booleans]
        parents += list(spec.booleans)
    if spec.categoricals:
        names = list(spec.categoricals)
        indexed = [f"{c}__i" for c in names]
        stages.append(
            StringIndexer(inputCols=names, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc")
        )
        out = indexed
        if kind == "one_hot":
            out = [f"{c}__h" for c in names]
            stages.append(OneHotEncoder(inputCols=indexed, outputCols=out, dropLast=True))
        elif kind == "target":
            out = [f"{c}__t" for c in names]
            means = [f"{c}__m" for c in names]
            stages.append(
                TargetEncoder(
                    inputCols=indexed, outputCols=means, labelCol=spec.target, targetType="continuous",
                    handleInvalid="keep", smoothing=1.0,
                )
            )
            # the encoder's columns still claim to be categories, which trees would take literally
            cells = ", ".join(f"`{m}` + 0.0D AS `{o}`" for m, o in zip(means, out))
            stages.append(SQLTransformer(statement=f"SELECT *, {cells} FROM __THIS__"))
        elif kind != "native":
            raise ValueError(f"unknown encoding {kind!r}")
        cols += out
        parents += names
    stages.append(VectorAssembler(inputCols=cols, outputCol="features"))
    return stages, cols, parents


def build_features(df: DataFrame, spec: FeatureSpec, kind: str = "one_hot", scale: bool = True) -> PipelineModel:
    """Feature pipeline fitted on these rows."""
    stages, _, _ = feature_stages(df, spec, kind, scale)
    return Pipeline(stages=stages).fit(df)


def feature_positions(encoded: DataFrame, spec: FeatureSpec, column: str = "features") -> list[str]:
    """Parent feature of every position of the assembled vector, from its metadata."""
    meta = encoded.schema[column].metadata["ml_attr"]
    names = sorted(
        (a for group in meta.get("attrs", {}).values() for a in group), key=lambda a: a["idx"]
    )
    known = sorted(spec.features, key=len, reverse=True)
    return [next(p for p in known if a["name"] == p or a["name"].startswith(p + "__")) for a in names]


def target_encode(df: DataFrame, names: Sequence[str], target: str, smoothing: float = 0.0) -> DataFrame:
    """Mean target per level beside each categorical as ``<name>__t``; fit it on training
    rows only when the result feeds a model."""
    indexed = [f"{c}__i" for c in names]
    out = [f"{c}__t" for c in names]
    stages = [
        StringIndexer(inputCols=list(names), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        TargetEncoder(
            inputCols=indexed, outputCols=out, labelCol=target, targetType="continuous",
            handleInvalid="keep", smoothing=smoothing,
        ),
    ]
    return Pipeline(stages=stages).fit(df).transform(df).drop(*indexed)


#: Rows of a bucket of the permutation that ordered target means run along.
BUCKET_ROWS = 200_000
#: Stands for a missing level, which is a level of its own.
NO_LEVEL = "\0"


def _level(name: str):
    return F.coalesce(col(name).cast("string"), F.lit(NO_LEVEL))


def ordered_target_encode(
    df: DataFrame, names: Sequence[str], target: str, key: Sequence[str], seed: int = 42, weight: float = 1.0,
    fold: str | None = None, folds: Sequence[int] = (), bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Mean target of the earlier rows of a row's level, as ``<name>__o``.

    Rows stand in the order of a seeded hash of their key; a row's encoding is
    (sum of earlier targets + weight * mean target) / (number of earlier targets + weight), so
    it never uses its own target.  With ``folds`` there is a column ``<name>__o<k>`` for each, which
    uses only rows outside fold k; the rows of fold k, not seen in training, get the mean over all others.

    The running sums are taken in two levels: the hash cuts the order into buckets of about
    ``bucket_rows`` rows, sums run inside a bucket, and what earlier buckets hold of a level is added.
    A level with any share of the rows is spread over all buckets, and rows are shuffled once.

    Rows of equal key are in no order among themselves: give a key that tells rows apart, or their
    encodings may change places.  A missing level is a level; a missing target counts for nothing.
    """
    held = [c for c in df.columns]
    digest = seeded_hash(key, seed)
    y = col(target).cast("double")
    sides = {f"{k}": F.when(~col(fold).eqNullSafe(F.lit(k)), y) for k in folds} if folds else {"": y}
    means = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m{k}") for k, v in sides.items()]).first()
    buckets = max(1, -(-means["n"] // bucket_rows))
    rows = df.withColumns({"__digest": digest, "__tie": F.xxhash64(*[col(c) for c in df.columns])})
    rows = rows.withColumn("__bucket", F.floor(hash_number(F.col("__digest")) * F.lit(buckets) / F.lit(1 << 32)))
    rows = rows.withColumns({f"__y{k}": v for k, v in sides.items()} | {f"__l{i}": _level(n) for i, n in enumerate(names)})
    out = rows.repartition("__bucket")
    for i in range(len(names)):
        inside = Window.partitionBy("__bucket", f"__l{i}").orderBy("__digest", "__tie").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({
            f"__{what}{i}_{k}": F.coalesce(fn(f"__y{k}").over(inside), F.lit(0)) for k in sides for what, fn in (("s", F.sum), ("n", F.count))})
    for i in range(len(names)):
        held_by = rows.groupBy("__bucket", f"__l{i}").agg(
            *[fn(f"__y{k}").alias(f"{what}{k}") for k in sides for what, fn in (("s", F.sum), ("n", F.count))])
        level = Window.partitionBy(f"__l{i}")
        earlier = level.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = held_by.select("__bucket", f"__l{i}", *[
            F.coalesce(F.sum(f"{what}{k}").over(w), F.lit(0)).alias(f"__{when}{what}{i}_{k}")
            for k in sides for what in "sn" for when, w in (("b", earlier), ("t", level))])
        out = out.join(offsets, ["__bucket", f"__l{i}"], "left")
    cells = {}
    for i, n in enumerate(names):
        for k in sides:
            prior = float(means[f"m{k}"] or 0.0)
            s, c = F.col(f"__s{i}_{k}") + F.col(f"__bs{i}_{k}"), F.col(f"__n{i}_{k}") + F.col(f"__bn{i}_{k}")
            if folds:
                unseen = col(fold).eqNullSafe(F.lit(int(k)))
                s = F.when(unseen, F.col(f"__ts{i}_{k}")).otherwise(s)
                c = F.when(unseen, F.col(f"__tn{i}_{k}")).otherwise(c)
            cells[f"{n}__o{k}"] = (s + weight * prior) / (c + weight)
    return out.select(*[col(c) for c in held], *[v.alias(n) for n, v in cells.items()])


def full_target_means(
    df: DataFrame, names: Sequence[str], target: str, weight: float = 1.0
) -> tuple[float, dict[str, DataFrame]]:
    """The mean target, and for each column its (level, mean) with the weight of the mean target:
    what ``ordered_target_encode`` comes to after all rows."""
    y = col(target).cast("double")
    prior = float(df.agg(F.avg(y).alias("m")).first()["m"] or 0.0)
    out = {}
    for n in names:
        sums = df.groupBy(_level(n).alias("level")).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
        out[n] = staged(sums.select("level", ((F.coalesce("s", F.lit(0.0)) + weight * prior) / (F.col("n") + weight)).alias("mean")), "means")
    return prior, out
