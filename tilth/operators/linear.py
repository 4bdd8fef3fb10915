"""Least squares and ridge from sufficient statistics, and the fitted linear model.

The model is a handful of numbers, so it scores as a column expression: no join, no
Python worker, one codegen stage over the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.functions.columns import col
from tilth.operators.gram import CONSTANT, FeatureSpec, Gram, collect_gram

COEF_SCHEMA = "position int, parent string, level string, kind string, coef double, mean double, scale double"


@dataclass
class LinearModel:
    """intercept + sum of coef * encoded value; numerics are (x - mean) / scale."""

    intercept: float
    numerics: dict[str, tuple[float, float, float]] = field(default_factory=dict)  # coef, mean, scale
    booleans: dict[str, float] = field(default_factory=dict)
    levels: dict[str, dict[str, float]] = field(default_factory=dict)

    @property
    def parents(self) -> list[str]:
        return [*self.numerics, *self.booleans, *self.levels]

    def term(self, parent: str, value: Column | None = None) -> Column:
        """Contribution of one original feature; an unknown level contributes 0, a missing value NULL."""
        v = col(parent) if value is None else value
        if parent in self.numerics:
            c, m, s = self.numerics[parent]
            return F.lit(c) * ((v.cast("double") - F.lit(m)) / F.lit(s))
        if parent in self.booleans:
            return F.lit(self.booleans[parent]) * v.cast("int").cast("double")
        known = [(k, c) for k, c in self.levels[parent].items()]
        if not known:
            return F.lit(0.0)
        table = F.create_map(*[F.lit(x) for pair in known for x in pair])
        return F.when(v.isNotNull(), F.coalesce(table[v.cast("string")], F.lit(0.0)))

    def raw(self, given: Mapping[str, Column] | None = None, without: tuple[str, ...] = ()) -> Column:
        """Prediction before clamping; ``given`` replaces columns, ``without`` leaves
        features out."""
        given = given or {}
        total = F.lit(self.intercept)
        for p in self.parents:
            if p not in without:
                total = total + self.term(p, given.get(p))
        return total

    def rows(self) -> list[tuple]:
        out = [(0, "", None, "intercept", self.intercept, 0.0, 1.0)]
        for p, (c, m, s) in self.numerics.items():
            out.append((len(out), p, None, "numeric", c, m, s))
        for p, c in self.booleans.items():
            out.append((len(out), p, None, "boolean", c, 0.0, 1.0))
        for p, lv in self.levels.items():
            for k, c in lv.items():
                out.append((len(out), p, k, "level", c, 0.0, 1.0))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """Coefficient table with its parent feature, in model order."""
        return spark.createDataFrame(self.rows(), COEF_SCHEMA)

    @staticmethod
    def from_rows(rows) -> LinearModel:
        model = LinearModel(0.0)
        for r in sorted(rows, key=lambda r: r["position"]):
            if r["kind"] == "intercept":
                model.intercept = r["coef"]
            elif r["kind"] == "numeric":
                model.numerics[r["parent"]] = (r["coef"], r["mean"], r["scale"])
            elif r["kind"] == "boolean":
                model.booleans[r["parent"]] = r["coef"]
            else:
                model.levels.setdefault(r["parent"], {})[r["level"]] = r["coef"]
        return model


def _encoded(gram: Gram, matrix: np.ndarray):
    """Split a Gram into the centred normal equations of standardised features."""
    spec = gram.spec
    one, target = gram.index(CONSTANT), gram.index((spec.target, None))
    inputs = [i for i, f in enumerate(gram.features) if i not in (one, target)]
    n = matrix[one, one]
    if n <= 0:
        raise ValueError("no rows to fit")
    mean = matrix[one, inputs] / n
    cov = matrix[np.ix_(inputs, inputs)] - n * np.outer(mean, mean)
    ybar = matrix[one, target] / n
    xy = matrix[inputs, target] - n * mean * ybar
    scale = np.ones(len(inputs))
    for k, i in enumerate(inputs):
        if gram.features[i][0] in spec.numerics:
            sd = np.sqrt(max(cov[k, k], 0.0) / n)
            # a column that only rounding makes vary counts as constant
            scale[k] = sd if sd > 1e-12 * max(1.0, abs(gram.shift.get(gram.features[i][0], 0.0))) else 1.0
    return inputs, n, mean, ybar, cov / np.outer(scale, scale), xy / scale, scale


def solve(gram: Gram, alpha: float = 0.0, leave_out=None, only=None) -> LinearModel:
    """Ridge (alpha > 0) or minimum-norm least squares (alpha = 0) on all parts, on all
    but one, or on one."""
    return solve_path(gram, [alpha], leave_out, only)[0]


def solve_path(gram: Gram, alphas: Sequence[float], leave_out=None, only=None) -> list[LinearModel]:
    """``solve`` for several penalties, all from one decomposition of the normal equations."""
    matrix = gram.parts[only] if only is not None else gram.total(leave_out)
    inputs, _, mean, ybar, a, b, scale = _encoded(gram, matrix)
    values, vectors = np.linalg.eigh(a)
    along = vectors.T @ b
    kept = np.abs(values) > 1e-10 * np.max(np.abs(values), initial=0.0)
    models = []
    for alpha in alphas:
        if alpha > 0:
            beta = vectors @ (along / (np.maximum(values, 0.0) + alpha))
        else:
            beta = vectors[:, kept] @ (along[kept] / values[kept])
        models.append(_model(gram, inputs, mean, ybar, scale, beta))
    return models


def _model(gram: Gram, inputs, mean, ybar, scale, beta) -> LinearModel:
    """The model of standardised coefficients."""
    spec = gram.spec
    model = LinearModel(0.0)
    model.levels = {c: {} for c in spec.categoricals}
    intercept = ybar + gram.shift.get(spec.target, 0.0)
    for k, i in enumerate(inputs):
        parent, level = gram.features[i]
        c = float(beta[k])
        if parent in spec.numerics:
            model.numerics[parent] = (c, float(mean[k] + gram.shift.get(parent, 0.0)), float(scale[k]))
        elif parent in spec.booleans:
            model.booleans[parent] = c
            intercept -= c * mean[k]
        else:
            model.levels[parent][level] = c
            intercept -= c * mean[k]
    model.intercept = float(intercept)
    return model


def gram_scores(gram: Gram, model: LinearModel, matrix: np.ndarray) -> dict[str, float]:
    """R2 and RMSE of a model on the rows behind a matrix, without reading them again."""
    spec = gram.spec
    one, target = gram.index(CONSTANT), gram.index((spec.target, None))
    weights = np.zeros(len(gram.features))
    weights[target] = 1.0
    offset = gram.shift.get(spec.target, 0.0) - model.intercept
    for i, (parent, level) in enumerate(gram.features):
        if parent in model.numerics:
            c, m, s = model.numerics[parent]
            weights[i] = -c / s
            offset -= c * (gram.shift.get(parent, 0.0) - m) / s
        elif parent in model.booleans:
            weights[i] = -model.booleans[parent]
        elif parent in model.levels:
            weights[i] = -model.levels[parent].get(level, 0.0)
    weights[one] = offset
    n = matrix[one, one]
    sse = max(float(weights @ matrix @ weights), 0.0)
    sst = float(matrix[target, target] - matrix[one, target] ** 2 / n)
    return {"rows": float(n), "r2": 1.0 - sse / sst if sst > 0 else float("nan"), "rmse": float(np.sqrt(sse / n))}


def ridge(df: DataFrame, spec: FeatureSpec, alpha: float = 1.0) -> LinearModel:
    """Minimise SSE + alpha * |coefficients|^2 with a free intercept."""
    return solve(collect_gram(df, spec), alpha)


def linear_regression(df: DataFrame, spec: FeatureSpec) -> LinearModel:
    """Ordinary least squares; of many equal solutions the one of least norm."""
    return solve(collect_gram(df, spec), 0.0)


def _coefficient_rows(models: Mapping[tuple, LinearModel], levels: Mapping[str, list[str]]) -> list[tuple]:
    """One row per model: its key, the constant of the unscaled features, and arrays of
    coefficients for numerics, booleans and the levels of every category."""
    rows = []
    for key, m in models.items():
        constant = m.intercept - sum(c * mean / s for c, mean, s in m.numerics.values())
        slopes = [c / s for c, _, s in m.numerics.values()]
        by_level = [[m.levels[c].get(k, 0.0) for k in known] + [0.0] for c, known in levels.items()]
        rows.append((*key, constant, slopes, list(m.booleans.values()), by_level))
    return rows


def path_errors(df: DataFrame, paths: Mapping[int, Sequence[LinearModel]], fold: str, target: str) -> DataFrame:
    """(trial, fold, mae): every row is scored by all models of its fold and stays one row.

    ``paths`` holds for every fold as many models as there are trials.  A row gets its fold's
    coefficients as arrays with a place per trial; the absolute errors of the trials are
    columns of one aggregate.
    """
    first = next(iter(paths.values()))
    trials, known = len(first), {}
    for c in first[0].levels:
        known[c] = sorted({k for models in paths.values() for m in models for k in m.levels[c]})
    rows = []
    for k, models in paths.items():
        parts = [r[1:] for r in _coefficient_rows({(t,): m for t, m in enumerate(models)}, known)]
        one, num, flags, lev = ([p[i] for p in parts] for i in range(4))
        turned = lambda lists: [list(x) for x in zip(*lists)]
        rows.append((int(k), one, turned(num), turned(flags), [turned(x) for x in turned(lev)]))
    shape = "_k int, _one array<double>, _num array<array<double>>, _bool array<array<double>>, _lev array<array<array<double>>>"
    table = df.sparkSession.createDataFrame(rows, shape)
    places = {}
    for i, (c, levels) in enumerate(known.items()):
        lookup = F.create_map(*[F.lit(x) for j, k in enumerate(levels) for x in (k, j)]) if levels else None
        places[f"_at{i}"] = F.lit(0) if lookup is None else F.coalesce(lookup[col(c).cast("string")], F.lit(len(levels)))
    slim = df.select(
        col(fold).cast("int").alias("_k"), col(target).cast("double").alias("_y"),
        *[col(n).cast("double").alias(f"_x{i}") for i, n in enumerate(first[0].numerics)],
        *[col(b).cast("int").alias(f"_f{i}") for i, b in enumerate(first[0].booleans)],
        *[place.alias(name) for name, place in places.items()],
    )
    # a row a fold: rows stay where they are, instead of meeting by fold in as many tasks as there are folds
    joined = slim.join(F.broadcast(table), "_k").select(
        "_k", "_y", "_one", "_num", "_bool", *[c for c in slim.columns if c[:2] in ("_x", "_f")],
        *[F.col("_lev")[i][F.col(name)].alias(f"_l{i}") for i, name in enumerate(places)],
    )

    def error(t: int) -> Column:
        total = F.col("_one")[t]
        for i in range(len(first[0].numerics)):
            total = total + F.col("_num")[i][t] * F.col(f"_x{i}")
        for i in range(len(first[0].booleans)):
            total = total + F.col("_bool")[i][t] * F.col(f"_f{i}")
        for i in range(len(places)):
            total = total + F.col(f"_l{i}")[t]
        return F.avg(F.abs(F.col("_y") - total)).alias(f"_mae{t}")

    wide = joined.groupBy("_k").agg(*[error(t) for t in range(trials)])
    cells = F.array(*[F.struct(F.lit(t).alias("trial"), F.col(f"_mae{t}").alias("mae")) for t in range(trials)])
    return wide.select(F.col("_k").alias("fold"), F.inline(cells))
