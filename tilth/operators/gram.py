"""Sufficient statistics: sums of products of encoded features, per fold, in one pass.

Rows are first aggregated to cells (one per observed combination of categories and
booleans), then every cell contributes its products to the entries of the matrix.  Both
steps combine on the map side, and what leaves Spark is one number per entry.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.functions.columns import col
from tilth.operators.clean import any_missing
from tilth.session import MAX_SMALL_ROWS, gather_small, one_row

CONSTANT = ("", None)
MAX_ENTRIES = 2_000_000


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns play which part.  ``banned`` columns are derived from the target and
    may never be features."""

    numerics: tuple[str, ...] = ()
    booleans: tuple[str, ...] = ()
    categoricals: tuple[str, ...] = ()
    target: str | None = None
    banned: tuple[str, ...] = ()

    def __post_init__(self):
        leaking = [c for c in self.features if c in self.banned or c == self.target]
        if leaking:
            raise ValueError(f"derived from the target, not allowed as features: {leaking}")

    @property
    def features(self) -> list[str]:
        return [*self.numerics, *self.booleans, *self.categoricals]

    @property
    def columns(self) -> list[str]:
        return self.features + ([self.target] if self.target else [])

    def with_numerics(self, extra: Sequence[str]) -> FeatureSpec:
        return FeatureSpec(
            (*self.numerics, *extra), self.booleans, self.categoricals, self.target, self.banned
        )


def _numbers(spec: FeatureSpec) -> list[str]:
    return [*spec.numerics, *([spec.target] if spec.target else [])]


def gram_cells(
    df: DataFrame, spec: FeatureSpec, by: str | None = None, shift: dict[str, float] | None = None
) -> DataFrame:
    """One row per observed combination of fold, booleans (_b0, ...) and categories
    (_c0, ...): the count _n, the sums _s0, ... and the product sums _q0_0, ... of the
    numerics and the target, each less its ``shift``."""
    shift = shift or {}
    numbers = _numbers(spec)
    x = [col(n).cast("double") - F.lit(float(shift.get(n, 0.0))) for n in numbers]
    group = ([F.col(by).alias("_by")] if by else []) + [
        *[col(b).cast("int").alias(f"_b{i}") for i, b in enumerate(spec.booleans)],
        *[col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(spec.categoricals)],
    ]
    sums = [F.count(F.lit(1)).cast("double").alias("_n")]
    sums += [F.sum(x[i]).alias(f"_s{i}") for i in range(len(x))]
    sums += [F.sum(x[i] * x[j]).alias(f"_q{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return df.groupBy(*group).agg(*sums) if group else df.agg(*sums)


def gram_table(
    df: DataFrame, spec: FeatureSpec, by: str | None = None, shift: dict[str, float] | None = None
) -> DataFrame:
    """Entries (by, parent_i, level_i, parent_j, level_j, value) of the upper triangle.

    A feature is a (parent, level) pair: ('', NULL) is the constant, level is NULL for
    numerics, booleans and the target.  ``shift`` is subtracted from numerics and target
    before multiplying, which keeps digits when a mean is large beside its deviation.
    """
    return _entries(gram_cells(df, spec, by, shift), spec, by)


def _entries(cells: DataFrame, spec: FeatureSpec, by: str | None) -> DataFrame:
    numbers = _numbers(spec)
    # (parent, level, kind, index) in matrix order; the product of two entries in a cell
    # follows from their kinds
    parts = [("", F.lit(None).cast("string"), "one", 0)]
    parts += [(n, F.lit(None).cast("string"), "num", i) for i, n in enumerate(numbers)]
    parts += [(b, F.lit(None).cast("string"), "bool", i) for i, b in enumerate(spec.booleans)]
    parts += [(c, F.col(f"_c{i}"), "cat", i) for i, c in enumerate(spec.categoricals)]

    def product(a, b):
        numeric = sorted(p[3] for p in (a, b) if p[2] == "num")
        base = {0: F.col("_n")}.get(len(numeric))
        if len(numeric) == 1:
            base = F.col(f"_s{numeric[0]}")
        elif len(numeric) == 2:
            base = F.col(f"_q{numeric[0]}_{numeric[1]}")
        for p in {p[0]: p for p in (a, b) if p[2] == "bool"}.values():
            base = base * F.col(f"_b{p[3]}")
        return base

    entries = F.array(
        *[
            F.struct(
                F.lit(a[0]).alias("parent_i"), a[1].alias("level_i"),
                F.lit(b[0]).alias("parent_j"), b[1].alias("level_j"),
                product(a, b).cast("double").alias("value"),
            )
            for i, a in enumerate(parts)
            for b in parts[i:]
        ]
    )
    keys = ["parent_i", "level_i", "parent_j", "level_j"]
    flat = cells.select(*(["_by"] if by else []), F.inline(entries))
    out = flat.groupBy(*(["_by"] if by else []), *keys).agg(F.sum("value").alias("value"))
    return out.withColumnRenamed("_by", by) if by else out


@dataclass
class Gram:
    """The matrix on the driver: p x p numbers per fold, p the number of encoded features."""

    spec: FeatureSpec
    features: list[tuple[str, str | None]]
    parts: dict
    shift: dict[str, float] = field(default_factory=dict)

    def index(self, feature) -> int:
        return self.features.index(feature)

    def total(self, leave_out=None) -> np.ndarray:
        kept = [m for k, m in self.parts.items() if k != leave_out or leave_out is None]
        return np.sum(kept, axis=0)

    @property
    def folds(self) -> list:
        return sorted(self.parts, key=lambda k: (k is None, k))


def collect_gram(
    df: DataFrame, spec: FeatureSpec, by: str | None = None,
    max_cells: int = MAX_SMALL_ROWS, max_entries: int = MAX_ENTRIES,
) -> Gram:
    """Aggregate on Spark and fetch the result, after a pass that finds the means (used
    as shift) and refuses rows with missing features.

    Few cells are fetched as they are; many are first added up to matrix entries on
    Spark.  The number of entries depends on the levels, never on the rows; beyond the
    bound use the row-based solver ``ridge_by_rows`` instead.
    """
    numbers = _numbers(spec)
    first = one_row(
        df.agg(
            F.count_if(any_missing([*spec.columns, *([by] if by else [])])).alias("_missing"),
            *[F.avg(col(n).cast("double")).alias(f"_m{i}") for i, n in enumerate(numbers)],
        )
    )
    if first["_missing"]:
        raise ValueError(f"{first['_missing']} rows lack a feature or the target; drop or impute them first")
    shift = {n: float(first[f"_m{i}"] or 0.0) for i, n in enumerate(numbers)}
    cells, rows = gather_small(gram_cells(df, spec, by, shift), max_cells)
    if rows is not None:
        features, parts = _from_cells(rows, spec, bool(by))
    else:
        features, parts = _from_entries(_entries(cells, spec, by), spec, by, max_entries)
    return Gram(spec, features, parts, shift)


def _from_cells(rows: list[dict], spec: FeatureSpec, folded: bool):
    """Matrix per fold from a short list of cells: with Z the indicators of a cell, the
    blocks are Z'nZ, Z's and the summed products."""
    k = len(_numbers(spec))
    levels = [sorted({r[f"_c{i}"] for r in rows}) for i in range(len(spec.categoricals))]
    features = [CONSTANT, *[(n, None) for n in [*_numbers(spec), *spec.booleans]]]
    features += [(c, lv) for c, known in zip(spec.categoricals, levels) for lv in known]
    n = np.array([r["_n"] for r in rows], float)
    z = np.column_stack(
        [np.ones(len(rows)), *[[float(r[f"_b{i}"]) for r in rows] for i in range(len(spec.booleans))]]
        + [[float(r[f"_c{i}"] == lv) for r in rows] for i, known in enumerate(levels) for lv in known]
    )
    s = np.array([[r[f"_s{i}"] or 0.0 for i in range(k)] for r in rows], float).reshape(len(rows), k)
    q = np.array(
        [[[r[f"_q{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)] for r in rows], float
    ).reshape(len(rows), k, k)
    other = [0, *range(k + 1, len(features))]  # places of the constant, booleans and levels
    fold = [r["_by"] if folded else None for r in rows]
    parts = {}
    for key in dict.fromkeys(fold):
        own = np.array([f == key for f in fold])
        m = np.zeros((len(features), len(features)))
        m[np.ix_(other, other)] = (z[own] * n[own, None]).T @ z[own]
        m[np.ix_(other, range(1, k + 1))] = z[own].T @ s[own]
        m[np.ix_(range(1, k + 1), other)] = m[np.ix_(other, range(1, k + 1))].T
        m[1 : k + 1, 1 : k + 1] = q[own].sum(axis=0)
        parts[key] = m
    return features, parts


def _from_entries(table: DataFrame, spec: FeatureSpec, by: str | None, max_entries: int):
    table = table.limit(max_entries + 1).toArrow()
    if table.num_rows > max_entries:
        raise ValueError(f"more than {max_entries} matrix entries: too many levels for this route")
    cols = {n: table.column(n).to_pylist() for n in table.column_names}
    order = {"": 0, **{n: 1 + i for i, n in enumerate([*_numbers(spec), *spec.booleans, *spec.categoricals])}}
    seen = set(zip(cols["parent_i"], cols["level_i"])) | set(zip(cols["parent_j"], cols["level_j"]))
    features = sorted(seen, key=lambda f: (order[f[0]], f[1] or ""))
    place = {f: i for i, f in enumerate(features)}
    parts: dict = {}
    bys = cols[by] if by else [None] * table.num_rows
    for k, pi, li, pj, lj, v in zip(
        bys, cols["parent_i"], cols["level_i"], cols["parent_j"], cols["level_j"], cols["value"]
    ):
        m = parts.setdefault(k, np.zeros((len(features), len(features))))
        i, j = place[(pi, li)], place[(pj, lj)]
        m[i, j] = m[j, i] = v
    return features, parts
