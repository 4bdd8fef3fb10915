"""Ridge over categories with any number of levels: the normal equations are never formed.

Rows are added up to cells (one per combination of wide categories), dealt once by the level
of the category with most levels, and packed into blocks that stay where they are.  That
category is taken out of the equations level by level: all cells of a level lie in one
block.  What is left are the few unknowns (intercept, numerics, booleans) and the levels of the
other categories, a vector of at most ``HELD_LEVELS`` numbers on the driver.  Preconditioned
conjugate gradients send it to the blocks, and add up what the blocks send back; no cell
is shuffled again.  With one category nothing is left but the few.

Where the other categories have more levels, all levels are a distributed table instead, written once an
iteration: a level's own part, its rows times its entry, and its sums of numerics times theirs, are
columns of its row, and the cells are joined with the other categories' levels and added up by level.
Only dot products and the few unknowns are then on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.functions.columns import col, unused
from tilth.operators.clean import any_missing
from tilth.operators.gram import FeatureSpec
from tilth.session import importable, one_row, staged

#: Most levels of all categories but the largest that are unknowns on the driver (8 bytes each).
HELD_LEVELS = 1_000_000
#: Rows, and so at most cells, of a block; numbers that blocks send to the driver at once.
BLOCK_ROWS, DIRECT = 2_000_000, 4_000_000


@dataclass
class WideModel:
    """intercept + few coefficients + a table (parent, level, coef) of the levels."""

    intercept: float
    numerics: dict[str, tuple[float, float, float]]  # coef, mean, scale
    booleans: dict[str, float]
    levels: DataFrame
    categoricals: tuple[str, ...]
    iterations: int
    residual: float

    def transform(self, df: DataFrame, into: str = "prediction") -> DataFrame:
        """Every row with its prediction: an unknown level counts as 0, a missing value gives
        NULL.  A category's levels are joined by shuffle or broadcast as Spark sees their size."""
        total: Column = F.lit(self.intercept)
        for n, (c, m, s) in self.numerics.items():
            total = total + F.lit(c) * ((col(n).cast("double") - F.lit(m)) / F.lit(s))
        for b, c in self.booleans.items():
            total = total + F.lit(c) * col(b).cast("int")
        names, out = list(df.columns), df
        for i, c in enumerate(self.categoricals):
            key, coef = unused(f"level{i}", out.columns), unused(f"coef{i}", out.columns)
            side = self.levels.where(F.col("parent") == c).select(F.col("level").alias(key), F.col("coef").alias(coef))
            out = out.join(side, col(c).cast("string") == F.col(key), "left")
            total = total + F.when(col(c).isNotNull(), F.coalesce(F.col(coef), F.lit(0.0)))
        return out.select(*[col(n) for n in names if n != into], total.alias(into))


def _moments(df: DataFrame, spec: FeatureSpec):
    """(rows, means and deviations of the numerics, mean of the target); missing values are refused."""
    row = one_row(
        df.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(any_missing(spec.columns)).alias("missing"),
            F.avg(col(spec.target).cast("double")).alias("y"),
            *[f(col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(spec.numerics) for k, f in (("m", F.avg), ("s", F.stddev_pop))],
        )
    )
    if row["missing"]:
        raise ValueError(f"{row['missing']} rows lack a feature or the target; drop or impute them first")
    if not row["n"]:
        raise ValueError("no rows to fit")
    mean = [float(row[f"m{i}"]) for i in range(len(spec.numerics))]
    sd = [float(row[f"s{i}"]) for i in range(len(spec.numerics))]
    scale = [s if s > 1e-12 * max(1.0, abs(m)) else 1.0 for m, s in zip(mean, sd)]
    return int(row["n"]), mean, scale, float(row["y"])


def _cells(df: DataFrame, spec: FeatureSpec, mean: Sequence[float], scale: Sequence[float], ybar: float) -> DataFrame:
    """One row per combination of wide categories (_g0, ...): rows, sums of the small features
    (_s0, ...; the first is the constant) and of the centred target."""
    small = [(col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(spec.numerics, mean, scale)]
    small += [col(b).cast("int").cast("double") for b in spec.booleans]
    keys = [col(c).cast("string").alias(f"_g{i}") for i, c in enumerate(spec.categoricals)]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_s0"),
        *[F.sum(x).alias(f"_s{i + 1}") for i, x in enumerate(small)],
        F.sum(col(spec.target).cast("double") - F.lit(ybar)).alias("_t"),
    )


def _small_block(df: DataFrame, spec: FeatureSpec, mean, scale, ybar) -> tuple[np.ndarray, np.ndarray]:
    """Products of the small features with each other and with the centred target."""
    x = [F.lit(1.0)]
    x += [(col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(spec.numerics, mean, scale)]
    x += [col(b).cast("int").cast("double") for b in spec.booleans]
    y, k = col(spec.target).cast("double") - F.lit(ybar), len(x)
    row = one_row(
        df.agg(
            *[F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)],
            *[F.sum(x[i] * y).alias(f"b{i}") for i in range(k)],
        )
    )
    gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return gram, np.array([row[f"b{i}"] for i in range(k)], float)


def _dot(weights: Sequence[float], columns: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for w, c in zip(weights, columns):
        total = total + F.lit(float(w)) * F.col(c)
    return total


def ridge_wide(df: DataFrame, spec: FeatureSpec, alpha: float = 1.0, tolerance: float = 1e-11, iterations: int = 500) -> WideModel:
    """Minimise SSE + alpha * |coefficients|^2 with a free intercept, as ``linear.ridge`` does,
    for categories of any number of levels.

    Stops when the preconditioned residual has shrunk by ``tolerance``; that many steps
    without it are an error, never a half-solved model.  ``alpha`` must be positive, as
    the indicators of a category add up to the constant.  Rows with a missing feature or target
    are refused, and so is an empty table.
    """
    if alpha <= 0:
        raise ValueError("a wide ridge needs a positive penalty")
    if not spec.categoricals:
        raise ValueError("no categories: use linear.ridge")
    n, mean, scale, ybar = _moments(df, spec)
    gram, b = _small_block(df, spec, mean, scale, ybar)
    small = gram + alpha * np.diag([0.0] + [1.0] * (len(b) - 1))
    held = _held_levels(df, spec, mean, scale, ybar)
    solve = _by_levels if held is None else _by_blocks
    x_s, levels, made, left = solve(df, spec, (n, mean, scale, ybar), small, b, alpha, tolerance, iterations, held)
    numerics = {c: (float(v), m, s) for c, v, m, s in zip(spec.numerics, x_s[1:], mean, scale)}
    flags = dict(zip(spec.booleans, map(float, x_s[1 + len(spec.numerics):])))
    return WideModel(float(x_s[0]) + ybar, numerics, flags, levels, spec.categoricals, made, left)


def _unsolved(iterations: int) -> RuntimeError:
    return RuntimeError(f"no solution within {iterations} iterations; raise the penalty or the number")


def _few(spec: FeatureSpec, mean: Sequence[float], scale: Sequence[float]) -> list[Column]:
    """The few features of a row: the constant, standardised numerics, booleans."""
    few = [F.lit(1.0)]
    few += [(col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(spec.numerics, mean, scale)]
    return few + [col(b).cast("int").cast("double") for b in spec.booleans]


@dataclass
class _Held:
    """The category that is taken out, and the levels of the others one after the other: names, sums of
    the few features and of the centred target."""

    main: str
    others: list[str]
    levels: dict[str, list[str]]
    few: np.ndarray
    target: np.ndarray


def _held_levels(df: DataFrame, spec: FeatureSpec, mean: Sequence[float], scale: Sequence[float], ybar: float) -> _Held | None:
    """None where all categories but the largest have more levels than the driver should hold."""
    names = list(spec.categoricals)
    about = one_row(df.agg(*[F.approx_count_distinct(col(c).cast("string")).alias(f"d{i}") for i, c in enumerate(names)]))
    main = max(range(len(names)), key=lambda i: about[f"d{i}"])
    others = [c for i, c in enumerate(names) if i != main]
    few = _few(spec, mean, scale)
    if not others:
        return _Held(names[main], [], {}, np.zeros((0, len(few))), np.zeros(0))
    if sum(about[f"d{i}"] for i in range(len(names)) if i != main) > 1.2 * HELD_LEVELS:
        return None
    sums = [f"_s{i}" for i in range(len(few))]
    lists = F.array(*[F.struct(F.lit(i).alias("c"), col(c).cast("string").alias("g")) for i, c in enumerate(others)])
    rows = df.select(F.explode(lists).alias("k"), *[f.alias(s) for f, s in zip(few, sums)], (col(spec.target).cast("double") - F.lit(ybar)).alias("_t"))
    table = rows.groupBy("k.c", "k.g").agg(*[F.sum(s).alias(s) for s in sums], F.sum("_t").alias("_t")).limit(HELD_LEVELS + 1).toArrow()
    if table.num_rows > HELD_LEVELS:
        return None
    table = table.sort_by([("c", "ascending"), ("g", "ascending")])
    levels = {c: table.filter(pc.equal(table["c"], i))["g"].to_pylist() for i, c in enumerate(others)}
    return _Held(names[main], others, levels, np.stack([table[s].to_numpy() for s in sums], axis=1), table["_t"].to_numpy())


@dataclass
class _Block:
    """All cells of some levels of the category that is taken out.  By level: sums of the few features (the
    first is its rows) and of the target.  By cell: its level, the places of its other levels, its rows."""

    few: np.ndarray
    target: np.ndarray
    at: np.ndarray
    places: list[np.ndarray]
    rows: np.ndarray

    def out(self, few: np.ndarray, others: np.ndarray) -> np.ndarray:
        """What the other unknowns add up to in every level's equation."""
        total = self.few @ few
        for p in self.places:
            total += np.bincount(self.at, self.rows * others[p], len(total))
        return total

    def back(self, levels: np.ndarray, many: int) -> np.ndarray:
        """What the levels' unknowns add to the equations of the few and of the other levels."""
        total, own = np.zeros(many), self.rows * levels[self.at]
        for p in self.places:
            total += np.bincount(p, own, many)
        return np.concatenate([self.few.T @ levels, total])

    def between(self, others: np.ndarray) -> np.ndarray:
        """What other categories' levels add to each other's equations."""
        total = np.zeros(len(others))
        every = sum(others[p] for p in self.places)
        for p in self.places:
            total += np.bincount(p, self.rows * (every - others[p]), len(others))
        return total


def _packed(df: DataFrame, spec: FeatureSpec, n: int, mean, scale, ybar: float, held: _Held) -> DataFrame:
    """The blocks as rows of bytes, written once: rows are shuffled by the level that is taken out, and
    the cells are added up where they come to lie."""
    spark = df.sparkSession
    importable(spark)
    few = _few(spec, mean, scale)
    k, first, rows = len(few), 0, df
    codes = []
    for i, c in enumerate(held.others):
        key, code = unused(f"_level{i}", rows.columns), unused(f"_code{i}", rows.columns)
        table = pa.table({key: pa.array(held.levels[c], pa.string()), code: pa.array(np.arange(first, first + len(held.levels[c]), dtype=np.int32))})
        rows = rows.join(F.broadcast(spark.createDataFrame(table)), col(c).cast("string") == F.col(key))
        codes.append(F.col(code).alias(f"_c{i}"))
        first += len(held.levels[c])
    slim = rows.select(
        col(held.main).cast("string").alias("_g"), *codes, *[f.alias(f"_s{i}") for i, f in enumerate(few)],
        (col(spec.target).cast("double") - F.lit(ybar)).alias("_t"))
    parts = max(spark.sparkContext.defaultParallelism, -(-n // BLOCK_ROWS))
    names = [f"_c{i}" for i in range(len(codes))]
    sums = [*[f"_s{i}" for i in range(k)], "_t"]
    cells = slim.repartition(parts, "_g").groupBy("_g", *names).agg(*[F.sum(s).alias(s) for s in sums])

    def pack(batches):
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        levels = table["_g"].combine_chunks().dictionary_encode()
        levels = levels.combine_chunks() if isinstance(levels, pa.ChunkedArray) else levels
        at, known = levels.indices.to_numpy(zero_copy_only=False).astype(np.int32), levels.dictionary
        by_level = [np.bincount(at, table[s].to_numpy(), len(known)) for s in sums]
        yield pa.RecordBatch.from_arrays(
            [pa.array([known.to_pylist()], pa.list_(pa.string())), pa.array([np.stack(by_level[:k], axis=1).tobytes()]), pa.array([by_level[k].tobytes()]),
             pa.array([at.tobytes()]), pa.array([[table[c].to_numpy().astype(np.int32).tobytes() for c in names]], pa.list_(pa.binary())),
             pa.array([table["_s0"].to_numpy().tobytes()])],
            names=["levels", "few", "target", "at", "places", "rows"])

    return staged(cells.mapInArrow(pack, "levels array<string>, few binary, target binary, at binary, places array<binary>, rows binary"), "blocks")


def _opened(few, target, at, places, rows) -> _Block:
    target = np.frombuffer(target)
    return _Block(np.frombuffer(few).reshape(len(target), -1), target, np.frombuffer(at, np.int32), [np.frombuffer(p, np.int32) for p in places], np.frombuffer(rows))


def _added(parts: RDD, numbers: int) -> np.ndarray:
    """Sum of a vector a partition; of many or long ones most is added up in tasks."""
    if parts.getNumPartitions() * numbers > DIRECT:
        return parts.treeReduce(np.add)
    return sum(parts.collect())


def _by_blocks(df: DataFrame, spec: FeatureSpec, moments, small: np.ndarray, b: np.ndarray, alpha: float, tolerance: float, iterations: int, held: _Held):
    """(few unknowns, table of levels, iterations, residual) with the largest category taken out."""
    spark, k, many = df.sparkSession, len(b), len(held.target)
    n, mean, scale, ybar = moments
    made_of = _packed(df, spec, n, mean, scale, ybar, held)
    given = made_of.select("few", "target", "at", "places", "rows").rdd.map(lambda r: _opened(*r))
    cores = spark.sparkContext.defaultParallelism
    given = (given.coalesce(cores) if given.getNumPartitions() > cores else given).persist(StorageLevel.MEMORY_AND_DISK)
    own = held.few[:, 0] + alpha if many else np.zeros(0)

    def gathered(work) -> np.ndarray:
        def run(blocks):
            total = None
            for block in blocks:
                found = work(block)
                total = found if total is None else total + found
            if total is not None:
                yield total

        return _added(given.mapPartitions(run), k + many)

    def start(block: _Block) -> np.ndarray:
        d = block.few[:, 0] + alpha
        close = np.zeros(many)
        for p in block.places:
            close += np.bincount(p, block.rows * block.rows / d[block.at], many)
        return np.concatenate([block.back(block.target / d, many), close, ((block.few / d[:, None]).T @ block.few).ravel()])

    first_pass = gathered(start)
    r = np.concatenate([b, held.target]) - first_pass[:k + many]
    near = np.maximum(own - first_pass[k + many:k + 2 * many], alpha)
    block_of_few = small - first_pass[k + 2 * many:].reshape(k, k)

    def eased(v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.linalg.solve(block_of_few, v[:k]), v[k:] / near])

    def times(v: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(v)

        def work(block: _Block) -> np.ndarray:
            v = sent.value
            found = -block.back(block.out(v[:k], v[k:]) / (block.few[:, 0] + alpha), many)
            if len(block.places) > 1:
                found[k:] += block.between(v[k:])
            return found

        found = gathered(work)
        sent.unpersist()
        return found + np.concatenate([small @ v[:k] + held.few.T @ v[k:], own * v[k:] + held.few @ v[:k]])

    x, z = np.zeros(k + many), eased(r)
    p, rz, made = z.copy(), float(r @ z), 0
    first = rz
    while first > 0 and rz > tolerance * tolerance * first:
        if made == iterations:
            raise _unsolved(iterations)
        q = times(p)
        step = rz / float(p @ q)
        x, r = x + step * p, r - step * q
        z = eased(r)
        rz, before, made = float(r @ z), rz, made + 1
        p = z + rz / before * p
    given.unpersist()

    held_main = held.main

    def solved(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _opened(*[row[c] for c in ("few", "target", "at", "places", "rows")])
                coef = (block.target - block.out(x[:k], x[k:])) / (block.few[:, 0] + alpha)
                yield pa.RecordBatch.from_arrays([pa.array([held_main] * len(coef)), pa.array(row["levels"], pa.string()), pa.array(coef)], names=["parent", "level", "coef"])

    levels = made_of.mapInArrow(solved, "parent string, level string, coef double")
    if many:
        parents = [c for c in held.others for _ in held.levels[c]]
        names = [g for c in held.others for g in held.levels[c]]
        levels = levels.unionByName(spark.createDataFrame(pa.table({"parent": parents, "level": names, "coef": x[k:]})))
    return x[:k], levels, made, float(np.sqrt(max(rz, 0.0) / first)) if first > 0 else 0.0


def _by_levels(df: DataFrame, spec: FeatureSpec, moments, small: np.ndarray, b: np.ndarray, alpha: float, tolerance: float, iterations: int, held: None):
    """(few unknowns, table of levels, iterations, residual) with all levels in a distributed table."""
    n, mean, scale, ybar = moments
    k, many = len(b), len(spec.categoricals)
    cells = staged(_cells(df, spec, mean, scale, ybar), "cells")
    sums = [f"_s{i}" for i in range(k)]
    lists = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"_g{i}").alias("g")) for i in range(many)])
    per_level = cells.select(F.explode(lists).alias("k"), *sums, "_t").groupBy("k.c", "k.g").agg(
        *[F.sum(s).alias(s) for s in sums], F.sum("_t").alias("r")
    )
    d = F.col("_s0") + F.lit(float(alpha))
    # x = 0, residual r = right side, direction p = preconditioned residual
    state = per_level.select("c", "g", *sums, F.lit(0.0).alias("x"), "r", (F.col("r") / d).alias("p"))
    x_s, r_s = np.zeros(k), b.copy()
    z_s = np.linalg.solve(small, r_s)
    p_s = z_s.copy()
    rz = first = None
    made = 0
    while True:
        own = d * F.col("p") + _dot(p_s, sums)
        if many == 1:
            whole = state.withColumn("q", own)
        else:
            whole = _with_others(staged(state, "direction"), cells, many, own)
        whole = staged(whole, "levels")
        dots = one_row(
            whole.agg(
                F.sum(F.col("p") * F.col("q")).alias("pq"),
                F.sum(F.col("r") * F.col("r") / d).alias("rr"),
                F.sum(F.col("r") * F.col("q") / d).alias("rq"),
                F.sum(F.col("q") * F.col("q") / d).alias("qq"),
                *[F.sum(F.col("p") * F.col(s)).alias(f"p{s}") for s in sums],
            )
        )
        q_s = small @ p_s + np.array([dots[f"p{s}"] for s in sums])
        if rz is None:
            rz = first = dots["rr"] + float(r_s @ z_s)
        if first <= 0 or rz <= tolerance * tolerance * first:
            break
        if made == iterations:
            raise _unsolved(iterations)
        step = rz / (dots["pq"] + float(p_s @ q_s))
        x_s, r_s = x_s + step * p_s, r_s - step * q_s
        z_s = np.linalg.solve(small, r_s)
        new = max(0.0, dots["rr"] - 2 * step * dots["rq"] + step * step * dots["qq"]) + float(r_s @ z_s)
        turn = new / rz
        p_s, rz, made = z_s + turn * p_s, new, made + 1
        left = F.col("r") - F.lit(step) * F.col("q")
        state = whole.select(
            "c", "g", *sums, (F.col("x") + F.lit(step) * F.col("p")).alias("x"), left.alias("r"),
            (left / d + F.lit(turn) * F.col("p")).alias("p"),
        )
    names = F.array(*[F.lit(c) for c in spec.categoricals])
    levels = whole.select(names[F.col("c")].alias("parent"), F.col("g").alias("level"), F.col("x").alias("coef"))
    return x_s, levels, made, float(np.sqrt(max(rz, 0.0) / first)) if first else 0.0


def _with_others(state: DataFrame, cells: DataFrame, many: int, own: Column) -> DataFrame:
    """The levels with the matrix times the direction: their own part, and what the cells'
    other categories add."""
    joined = cells
    for i in range(many):
        side = state.where(F.col("c") == i).select(F.col("g").alias(f"_g{i}"), F.col("p").alias(f"_p{i}"))
        joined = joined.join(side, f"_g{i}")
    every = sum((F.col(f"_p{i}") for i in range(1, many)), F.col("_p0"))
    rest = F.array(
        *[F.struct(F.lit(i).alias("c"), F.col(f"_g{i}").alias("g"), (F.col("_s0") * (every - F.col(f"_p{i}"))).alias("v")) for i in range(many)]
    )
    added = joined.select(F.inline(rest)).groupBy("c", "g").agg(F.sum("v").alias("_rest"))
    return state.join(added, ["c", "g"]).withColumn("q", own + F.col("_rest")).drop("_rest")
