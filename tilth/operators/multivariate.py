"""Principal components and mixed-data axes.

``pca`` and ``famd`` let Spark sum the products and decompose one p x p matrix on the driver,
p the number of encoded columns; ``leading_axes`` finds the first axes of very many columns
or levels without any p x p matrix.  Coordinates are column expressions over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.functions.columns import col
from tilth.operators.clean import any_missing
from tilth.operators.gram import CONSTANT, FeatureSpec, Gram, collect_gram
from tilth.operators.stats import as_number
from tilth.session import importable, one_row


@dataclass
class Axes:
    """Fitted axes: features (parent, level), their centre and scale, and per component
    an eigenvalue and a unit vector whose largest entry is positive."""

    features: list[tuple[str, str | None]]
    centre: np.ndarray
    scale: np.ndarray
    values: np.ndarray
    vectors: np.ndarray  # one column per component
    inertia: float

    @property
    def k(self) -> int:
        return len(self.values)

    def variance_table(self, spark: SparkSession) -> DataFrame:
        """Component, eigenvalue, share of inertia in percent and its running total."""
        share = 100.0 * self.values / self.inertia
        rows = [
            (i + 1, float(v), float(s), float(c))
            for i, (v, s, c) in enumerate(zip(self.values, share, np.cumsum(share)))
        ]
        return spark.createDataFrame(rows, "component int, eigenvalue double, percent double, cumulative double")

    def loading_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (p, lv, j + 1, float(self.vectors[i, j]))
            for i, (p, lv) in enumerate(self.features)
            for j in range(self.k)
        ]
        return spark.createDataFrame(rows, "parent string, level string, component int, loading double")

    def circle_table(self, spark: SparkSession, x: int, y: int) -> DataFrame:
        """Loadings of two axes side by side, as drawn in a correlation circle."""
        rows = [
            (p, lv, float(self.vectors[i, x - 1]), float(self.vectors[i, y - 1]))
            for i, (p, lv) in enumerate(self.features)
        ]
        return spark.createDataFrame(rows, "parent string, level string, x double, y double")

    def contribution_table(self, spark: SparkSession) -> DataFrame:
        """Part of every original variable in every axis; each axis adds up to 1."""
        parents = list(dict.fromkeys(p for p, _ in self.features))
        squared = self.vectors**2
        rows = [
            (p, j + 1, float(sum(squared[i, j] for i, f in enumerate(self.features) if f[0] == p)))
            for p in parents
            for j in range(self.k)
        ]
        return spark.createDataFrame(rows, "parent string, component int, contribution double")

    def coordinates(self, component: int) -> Column:
        """Score of a row on one axis as a column expression."""
        weights = self.vectors[:, component - 1] / self.scale
        total = F.lit(-float(weights @ self.centre))
        by_parent: dict[str, dict] = {}
        for (p, lv), w in zip(self.features, weights):
            by_parent.setdefault(p, {})[lv] = float(w)
        for p, lv in by_parent.items():
            if None in lv:
                total = total + F.lit(lv[None]) * col(p).cast("double")
            else:
                table = F.create_map(*[F.lit(x) for pair in lv.items() for x in pair])
                total = total + F.coalesce(table[col(p).cast("string")], F.lit(0.0))
        return total

    def transform(self, df: DataFrame, prefix: str = "PC") -> DataFrame:
        return df.withColumns({f"{prefix}{i + 1}": self.coordinates(i + 1) for i in range(self.k)})


def _decompose(features, centre, scale, cov, k, inertia) -> Axes:
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    return _axes(features, centre, scale, values[order], vectors[:, order], inertia)


def _axes(features, centre, scale, values, vectors, inertia) -> Axes:
    values = np.maximum(values, 0.0)
    for j in range(vectors.shape[1]):
        top = np.argmax(np.round(np.abs(vectors[:, j]), 10))  # first of equal entries
        if vectors[top, j] < 0:
            vectors[:, j] = -vectors[:, j]
    return Axes(features, centre, scale, values, vectors, inertia)


def _moments(gram: Gram):
    m = gram.total()
    one = gram.index(CONSTANT)
    inputs = [i for i, f in enumerate(gram.features) if i != one]
    n = m[one, one]
    mean = m[one, inputs] / n
    cov = m[np.ix_(inputs, inputs)] / n - np.outer(mean, mean)
    features = [gram.features[i] for i in inputs]
    shift = np.array([gram.shift.get(p, 0.0) if lv is None else 0.0 for p, lv in features])
    return features, mean, mean + shift, cov


def pca(df: DataFrame, names: Sequence[str], k: int | None = None) -> Axes:
    """Principal components of standardised columns (booleans as 0 and 1).  A constant
    column keeps scale 1 and adds no inertia."""
    spec = FeatureSpec(numerics=tuple(names))
    features, _, centre, cov = _moments(collect_gram(df, spec))
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale = np.where(sd > 1e-12 * np.maximum(1.0, np.abs(centre)), sd, 1.0)
    corr = cov / np.outer(scale, scale)
    return _decompose(features, centre, scale, corr, k or len(names), float(np.trace(corr)))


def famd(df: DataFrame, numerics: Sequence[str], categoricals: Sequence[str], k: int | None = 5) -> Axes:
    """Factor analysis of mixed data (Pages 2004): numerics standardised, every indicator
    centred and divided by the root of its share.  Booleans count as categories.
    Total inertia is the number of numerics plus the sum of (levels - 1)."""
    spec = FeatureSpec(numerics=tuple(numerics), categoricals=tuple(categoricals))
    features, mean, centre, cov = _moments(collect_gram(df, spec))
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale = np.array(
        [
            (sd[i] if sd[i] > 1e-12 * max(1.0, abs(centre[i])) else 1.0) if lv is None else np.sqrt(mean[i])
            for i, (_, lv) in enumerate(features)
        ]
    )
    weighted = cov / np.outer(scale, scale)
    return _decompose(features, centre, scale, weighted, k, float(np.trace(weighted)))


def _leading(product: Callable[[np.ndarray], np.ndarray], p: int, k: int, seed: int, tolerance: float, passes: int):
    """The k largest eigenvalues and vectors of a symmetric matrix that is only ever multiplied
    with a block of vectors: block Krylov steps with restarts, at most eight blocks kept."""
    wide = min(p, k + 4)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, wide)))[0]
    basis = image = np.zeros((p, 0))
    for _ in range(passes):
        basis, image = np.hstack([basis, block]), np.hstack([image, product(block)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        away = image @ turn[:, :wide] - (basis @ turn[:, :wide]) * values[:wide]
        off = np.linalg.norm(away[:, :k], axis=0).max(initial=0.0)
        if basis.shape[1] >= p or off <= tolerance * max(values[0], 1e-300):
            return values[:k], basis @ turn[:, :k]
        if basis.shape[1] + wide > 8 * wide:
            basis, image = basis @ turn[:, : 3 * wide], image @ turn[:, : 3 * wide]
        for _ in range(2):
            away = away - basis @ (basis.T @ away)
        block, r = np.linalg.qr(away[:, : p - basis.shape[1]])
        block = block[:, np.abs(np.diag(r)) > 1e-13 * max(values[0], 1e-300)]
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        if not block.shape[1]:
            return values[:k], basis @ turn[:, :k]
    raise RuntimeError(f"the axes did not settle within {passes} passes")


def leading_axes(
    df: DataFrame, numerics: Sequence[str] = (), categoricals: Sequence[str] = (), k: int = 5, seed: int = 42,
    tolerance: float = 1e-9, passes: int = 100, max_levels: int = 1_000_000,
) -> Axes:
    """The first k axes of ``pca`` (without categories) or ``famd``, in memory linear in the columns.

    A pass sends a block of at most k + 4 vectors to the tasks, which multiply their rows with it
    and back, and add up one number per column and vector; the driver holds eight such blocks
    at most.  Passes go on until every axis is an eigenvector up to ``tolerance`` times the first
    eigenvalue; ``passes`` without that are an error.  Levels are listed on the driver, more than
    ``max_levels`` of a category are refused, as are rows with missing values and an empty table.
    """
    spark = df.sparkSession
    importable(spark)
    numbers = [as_number(df, n) for n in numerics]
    row = one_row(
        df.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(any_missing([*numerics, *categoricals])).alias("missing"),
            *[f(x).alias(f"{t}{i}") for i, x in enumerate(numbers) for t, f in (("m", F.avg), ("s", F.stddev_pop))],
        )
    )
    if row["missing"]:
        raise ValueError(f"{row['missing']} rows lack a value; drop or impute them first")
    if not row["n"]:
        raise ValueError("no rows to fit")
    n, features = row["n"], [(c, None) for c in numerics]
    centre = [float(row[f"m{i}"]) for i in range(len(numbers))]
    spread = [float(row[f"s{i}"]) for i in range(len(numbers))]
    varies = [s > 1e-12 * max(1.0, abs(m)) for s, m in zip(spread, centre)]
    scale = [s if v else 1.0 for s, v in zip(spread, varies)]
    inertia, levels = float(sum(varies)), []
    for c in categoricals:
        counts = df.groupBy(col(c).cast("string").alias("level")).count().limit(max_levels + 1).toArrow()
        if counts.num_rows > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels")
        known = sorted(zip(counts["level"].to_pylist(), counts["count"].to_pylist()))
        levels.append(pa.array([lv for lv, _ in known], pa.string()))
        features += [(c, lv) for lv, _ in known]
        centre += [m / n for _, m in known]
        scale += [float(np.sqrt(m / n)) for _, m in known]
        inertia += len(known) - 1
    centre, scale = np.array(centre), np.array(scale)
    p, few = len(features), len(numbers)
    starts = np.cumsum([few, *[len(lv) for lv in levels]])
    slim = df.select(
        *[x.alias(f"x{i}") for i, x in enumerate(numbers)], *[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(categoricals)]
    )
    shared = spark.sparkContext.broadcast((centre, levels))  # p numbers and the levels' names

    def product(block: np.ndarray) -> np.ndarray:
        scaled = block / scale[:, None]
        sent = spark.sparkContext.broadcast(scaled)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (middle, names), by = shared.value, sent.value
            # numerics are centred row by row; the indicators' centre is taken off as one vector
            constant = middle[few:] @ by[few:]
            total, whole, seen = np.zeros((p, by.shape[1])), np.zeros(by.shape[1]), 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                seen += batch.num_rows
                x = np.zeros((batch.num_rows, 0))
                if few:
                    x = np.stack([np.asarray(batch.column(i).cast(pa.float64())) for i in range(few)], axis=1) - middle[:few]
                codes = [np.asarray(pc.index_in(batch.column(few + i), lv)) + starts[i] for i, lv in enumerate(names)]
                along = x @ by[:few] - constant
                for at in codes:
                    along += by[at]
                total[:few] += x.T @ along
                whole += along.sum(axis=0)
                for i, at in enumerate(codes):
                    for j in range(by.shape[1]):
                        total[starts[i]:starts[i + 1], j] += np.bincount(at - starts[i], along[:, j], len(names[i]))
            if seen:
                total[few:] -= middle[few:, None] * whole
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(p), by.shape[1])), pa.array(np.tile(np.arange(by.shape[1]), p)), pa.array(total.ravel())],
                    names=["i", "j", "v"])

        added = slim.mapInArrow(work, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros_like(block)
        out[added["i"].to_numpy(), added["j"].to_numpy()] = added["v"].to_numpy()
        sent.destroy()
        return out / scale[:, None] / n

    values, vectors = _leading(product, p, min(k, p), seed, tolerance, passes)
    shared.destroy()
    return _axes(features, centre, scale, values, vectors, inertia)
