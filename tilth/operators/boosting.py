"""Gradient boosting on histograms: many models and folds grown in the same passes.

Rows are binned once (a byte a feature where bins allow) and kept as blocks of columns with
their residuals.  A pass goes over the blocks once for all models that still grow: every task
adds up residuals and counts by (model, node, column, bin), and only these sums, whose size
does not depend on the rows, are brought together.  From them the driver takes each node's best
split.  A row is summed once a pass, for the leaf it lies in; a node's sums are its leaves'.

Trees grow by the best leaf (``leaves`` within ``depth``), or symmetrically, with one split for all
nodes of a level.  Level by level a tree would take a pass a level.  Instead the driver grows a
proposal on ``SAMPLE`` rows, others every round, of the ``POOL`` rows of smallest hash, and one pass
sums all its nodes on all rows.  From the top down a proposed split stands if on all rows it gains
less than the node's best split by no more than ``tie`` of the squared error there is, or if the
tree so gives up no more than ``slack`` of its gain.  Otherwise the best split takes its place,
and the part below is proposed and summed anew, unless the split itself gains no more than the
tie.  Which leaves are split, their gains and their values come from all rows only, and what is
given up is measured on all rows; with slack and tie 0 the trees are those of exact best splits.

Sums are of whole numbers (residuals times a power of two, see ``_scale``), so they do not depend
on how rows are dealt or added up, and the same table gives the same model.  Residuals are
brought up to date every ``ADVANCE`` rounds, as a persisted table that is checkpointed in
the shared folder every ``CUT`` times; the checkpoint before is then deleted.  A lost executor's
blocks are computed again from the checkpoint and the trees since.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.functions.columns import col
from tilth.operators.features import full_target_means, ordered_target_encode, vocabulary
from tilth.operators.gram import FeatureSpec
from tilth.session import importable, shared_dir, staged

#: Most bins of a number, not counting that of missing values.
BINS = 255
#: Different values that the cuts of a number are chosen from, at most about so many.
CUT_VALUES = 65_536
#: Rows in a block, and rows below which a block is not made smaller for the sake of more tasks.
BLOCK, LEAST_BLOCK = 262_144, 4_096
#: Rows that trees are proposed on, and those that they are taken from in turn.
SAMPLE, POOL = 10_000, 30_000
#: Rounds between updates of the residuals, and updates between checkpoints.
ADVANCE, CUT = 4, 16
#: Partitions whose sums the driver adds up itself; those of more are added up in tasks first.
DIRECT = 64


# ---- columns ------------------------------------------------------------------------


@dataclass(frozen=True)
class Binned:
    """One column of the binned table: a number cut into ranges, or the levels of a category.

    Code 0 is a missing number or an unknown level.  A number splits at "at most the cut",
    missing values with the low ones; a category splits one level from all others, which is
    what an indicator column for each level would offer.
    """

    source: str
    parent: str
    cuts: tuple[float, ...] | None = None
    levels: tuple[str, ...] | None = None

    @property
    def bins(self) -> int:
        return (len(self.cuts) + 2) if self.levels is None else len(self.levels) + 1

    def codes(self, column: pa.Array) -> np.ndarray:
        kind = np.uint8 if self.bins <= 256 else np.uint16
        if self.levels is not None:
            return (pc.index_in(column, pa.array(self.levels, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False) + 1).astype(kind)
        x = column.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        return np.where(np.isnan(x), 0, np.searchsorted(np.array(self.cuts), x, side="left") + 1).astype(kind)


def _read(columns: Sequence[Binned]) -> list:
    """The columns as the codes need them, by source."""
    found = {c.source: col(c.source).cast("string" if c.levels is not None else "double").alias(c.source) for c in columns}
    return list(found.values())


def number_cuts(df: DataFrame, names: Sequence[str], bins: int = BINS, values: int = CUT_VALUES) -> dict[str, tuple[float, ...]]:
    """Cuts that put about equal numbers of rows between them.

    A cut is half way between two values.  A column of at most ``bins`` values is cut between all;
    otherwise cuts are quantiles over
    the counts of its different values, of which about ``values`` are picked by hash before
    anything is shuffled; where there are no more than that, all are counted.
    """
    if not names:
        return {}
    x = {n: F.when(~F.isnan(col(n).cast("double")), col(n).cast("double")) for n in names}
    found = df.agg(*[F.approx_count_distinct(x[n]).alias(f"d{i}") for i, n in enumerate(names)]).first()
    cells = []
    for i, n in enumerate(names):
        share = min(1.0, values / max(1, found[f"d{i}"]) / 1.1)
        picked = F.lit(True) if share > 0.8 else F.pmod(F.xxhash64(x[n]), F.lit(1 << 20)) < int(share * (1 << 20))
        cells.append(F.when(x[n].isNotNull() & picked, F.struct(F.lit(i).alias("i"), x[n].alias("x"))))
    pairs = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.i", "c.x").agg(F.count("*").alias("n"))
    table = pairs.toArrow().to_pandas().sort_values(["i", "x"])
    cuts = {}
    for i, n in enumerate(names):
        part = table[table["i"] == i]
        every, counts = part["x"].to_numpy(), part["n"].to_numpy()
        at = np.arange(len(every))
        if len(every) > bins:
            upto = np.cumsum(counts)
            wanted = upto[-1] * np.arange(1, bins) / bins
            at = np.unique(np.searchsorted(upto, wanted, side="left"))
        at = at[at < len(every) - 1]
        low, high = every[at], every[at + 1] if len(at) else every[at]
        with np.errstate(invalid="ignore"):
            middle = low + (high - low) / 2
        cuts[n] = tuple(np.where(middle < high, middle, low).tolist())
    return cuts


# ---- trees --------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in parallel lists; ``column`` is -1 at a leaf.  ``share`` is what a split gains."""

    column: list[int] = field(default_factory=lambda: [-1])
    code: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, code: int, gain: float) -> int:
        """Make a leaf a split; its children are the number returned and the next."""
        self.column[node], self.code[node], self.left[node], self.gain[node] = column, code, len(self.column), gain
        for _ in range(2):
            self.column.append(-1)
            self.code.append(0)
            self.left.append(0)
            self.value.append(0.0)
            self.gain.append(0.0)
        return self.left[node]

    def visits(self, codes: Sequence[np.ndarray], is_level: Sequence[bool], rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Every node that some of the rows reach, with those rows."""
        waiting = [(0, rows)]
        while waiting:
            node, at = waiting.pop()
            yield node, at
            c = self.column[node]
            if c < 0:
                continue
            x = codes[c][at]
            low = x == self.code[node] if is_level[c] else x <= self.code[node]
            for child, rest in ((self.left[node], at[low]), (self.left[node] + 1, at[~low])):
                if len(rest):
                    waiting.append((child, rest))

    def places(self, codes: Sequence[np.ndarray], is_level: Sequence[bool], n: int) -> np.ndarray:
        """The leaf of each of ``n`` rows.

        Rows are not gathered: every split compares a whole column of codes and narrows a mask of a
        byte a row, which is a few nanoseconds a row for a whole tree.
        """
        out = np.zeros(n, np.uint8 if len(self.column) <= 256 else np.uint16)
        compared: dict[tuple[int, int], np.ndarray] = {}
        waiting = [(0, np.ones(n, bool))]
        while waiting:
            node, here = waiting.pop()
            c = self.column[node]
            if c < 0:
                out |= here.view(np.uint8) * out.dtype.type(node)
                continue
            key = (c, self.code[node])
            if key not in compared:
                compared[key] = codes[c] == self.code[node] if is_level[c] else codes[c] <= self.code[node]
            low = here & compared[key]
            waiting += [(self.left[node], low), (self.left[node] + 1, here ^ low)]
        return out

    def values(self, codes: Sequence[np.ndarray], is_level: Sequence[bool], n: int) -> np.ndarray:
        """What the tree adds to each of ``n`` rows."""
        return np.array(self.value)[self.places(codes, is_level, n)]


@dataclass(frozen=True)
class Plan:
    """How a model is grown, and which fold it does not see (None: it sees all rows)."""

    name: str
    columns: tuple[int, ...]
    rounds: int
    rate: float
    depth: int
    leaves: int
    least: int
    penalty: float = 0.0
    symmetric: bool = False
    slack: float = 0.0
    tie: float = 0.0
    out: int | None = None


@dataclass
class Ensemble:
    """A boosted model: binned columns, trees, and the means that encoded categories stand for."""

    columns: list[Binned]
    base: float
    trees: list[Tree]
    encoded: dict[str, DataFrame] = field(default_factory=dict)
    defaults: dict[str, float] = field(default_factory=dict)

    def transform(self, df: DataFrame, into: str = "prediction") -> DataFrame:
        """The table with a prediction for every row, whatever it misses."""
        importable(df.sparkSession)
        columns, trees, base = self.columns, self.trees, self.base
        wide = df
        for name, means in self.encoded.items():
            table = means.select(F.col("level").alias(f"{name}__level"), F.col("mean").alias(f"{name}__o"))
            wide = wide.join(table, F.coalesce(col(name).cast("string"), F.lit("\0")) == F.col(f"{name}__level"), "left")
            wide = wide.withColumn(f"{name}__o", F.coalesce(F.col(f"{name}__o"), F.lit(self.defaults[name]))).drop(f"{name}__level")
        sources = list(dict.fromkeys(c.source for c in columns))
        is_level = [c.levels is not None for c in columns]

        def score(*given: pa.Array) -> pa.Array:
            by = dict(zip(sources, given))
            codes = [c.codes(by[c.source]) for c in columns]
            out = np.full(len(given[0]), base)
            for tree in trees:
                out += tree.values(codes, is_level, len(out))
            return pa.array(out)

        scored = F.arrow_udf(score, "double")(*_read(columns))
        return wide.withColumn(into, scored).drop(*[f"{n}__o" for n in self.encoded])

    def importances(self) -> dict[str, float]:
        """Share of all splits' gain by feature."""
        totals = {c.parent: 0.0 for c in self.columns}
        for tree in self.trees:
            for column, gain in zip(tree.column, tree.gain):
                if column >= 0:
                    totals[self.columns[column].parent] += gain
        every = sum(totals.values())
        return {k: v / every if every else 0.0 for k, v in totals.items()}

    def save(self, spark: SparkSession, path: str) -> str:
        """One row a tree, beside the columns and the encoded categories' means."""
        about = {"base": self.base, "defaults": self.defaults, "encoded": sorted(self.encoded),
                 "columns": [[c.source, c.parent, c.cuts, c.levels] for c in self.columns]}
        rows = [(-1, json.dumps(about))] + [(i, json.dumps([t.column, t.code, t.left, t.value, t.gain])) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "tree int, body string").write.mode("overwrite").parquet(f"{path}/trees")
        for name, means in self.encoded.items():
            means.write.mode("overwrite").parquet(f"{path}/means/{name}")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        rows = [json.loads(r.body) for r in spark.read.parquet(f"{path}/trees").orderBy("tree").collect()]  # a row a tree
        about, trees = rows[0], [Tree(*r) for r in rows[1:]]
        columns = [Binned(s, p, None if c is None else tuple(c), None if v is None else tuple(v)) for s, p, c, v in about["columns"]]
        encoded = {n: spark.read.parquet(f"{path}/means/{n}") for n in about["encoded"]}
        return Ensemble(columns, about["base"], trees, encoded, about["defaults"])


# ---- inside tasks -------------------------------------------------------------------


@dataclass
class Block:
    """Binned columns, folds and targets of some rows, and the residuals of every model.  Passes carry no
    targets, which are met before the first and not again, and no folds if no model leaves one out."""

    codes: list[np.ndarray]
    fold: np.ndarray
    y: np.ndarray
    left_over: list[np.ndarray]


@dataclass(frozen=True)
class Task:
    """What a pass does for one model: trees to apply first, and the leaves of a growing tree to sum."""

    plan: Plan
    scale: float
    apply: tuple[Tree, ...]
    tree: Tree | None = None
    nodes: tuple[int, ...] = ()


def _updated(block: Block, model: int, trees: Sequence[Tree], is_level: Sequence[bool]) -> np.ndarray:
    if not trees:
        return block.left_over[model]
    rest = block.left_over[model].copy()
    for tree in trees:
        rest -= tree.values(block.codes, is_level, len(rest))
    return rest


def _together(columns: Sequence[int], bins: Sequence[int], most: int) -> list[list[int]]:
    """Columns in groups of at most ``most`` combinations of bins each (a wider column stays alone)."""
    groups: list[list[int]] = []
    sizes: list[int] = []
    for c in sorted(columns, key=lambda c: -bins[c]):
        fits = [i for i, size in enumerate(sizes) if size * bins[c] <= most]
        if fits:
            groups[fits[0]].append(c)
            sizes[fits[0]] *= bins[c]
        else:
            groups.append([c])
            sizes.append(bins[c])
    return groups


def _summed(block: Block, task: Task, rest: np.ndarray, is_level: Sequence[bool], bins: Sequence[int]) -> np.ndarray:
    """Sums and counts by (node, column, bin), columns side by side: an array [2, nodes, bins].

    Columns of few bins are counted together, by their combinations, and each one's sums are added
    up from those; sums are of whole numbers, so that changes nothing.
    """
    plan, nodes = task.plan, len(task.nodes)
    slot_of = np.full(len(task.tree.column), nodes)  # rows that are not wanted go to a slot of their own
    slot_of[list(task.nodes)] = np.arange(nodes)
    slot = slot_of[task.tree.places(block.codes, is_level, len(rest))]
    if plan.out is not None:
        slot[block.fold == plan.out] = nodes
    weights, codes = np.rint(rest * task.scale), block.codes
    wanted = slot < nodes
    if np.count_nonzero(wanted) < 0.7 * len(slot):
        at = np.flatnonzero(wanted)
        slot, weights, codes = slot[at], weights[at], {c: block.codes[c][at] for c in plan.columns}
    out = {}
    for group in _together(plan.columns, bins, len(slot) // (8 * (nodes + 1))):
        shape = [nodes + 1, *[bins[c] for c in group]]
        key = slot
        for c in group:
            key = key * bins[c] + codes[c]
        size = int(np.prod(shape))
        both = [np.bincount(key, w, size).reshape(shape)[:nodes] for w in (weights, None)]
        for i, c in enumerate(group):
            others = tuple(j + 1 for j in range(len(group)) if j != i)
            out[c] = [x.sum(axis=others) if others else x for x in both]
    return np.array([np.concatenate([out[c][k] for c in plan.columns], axis=1) for k in (0, 1)]).astype(np.int64)


def _added(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b)]


def _packed(made: list) -> list:
    """Sums and counts as they travel: counts in as few bytes as hold them, and only the cells that hold rows
    if a quarter are empty (the leaves of a small table have few rows for many bins)."""
    out = []
    for both in made:
        if both.dtype != np.int64:  # sums of errors, a few numbers
            out.append((None, None, both, None))
            continue
        sums, counts = both.reshape(2, -1)
        counts = counts.astype(next((t for t in (np.uint8, np.uint16, np.int32) if not len(counts) or counts.max() <= np.iinfo(t).max), np.int64))
        full = np.flatnonzero(counts).astype(np.int32)
        out.append((both.shape, full, sums[full], counts[full]) if len(full) < 0.75 * len(counts) else (both.shape, None, sums, counts))
    return out


def _opened(packed: list) -> list:
    out = []
    for shape, full, sums, counts in packed:
        if shape is None:
            out.append(sums)
            continue
        both = np.zeros((2, int(np.prod(shape[1:]))), np.int64)
        both[:, slice(None) if full is None else full] = sums, counts
        out.append(both.reshape(shape))
    return out


# ---- growth on the driver -----------------------------------------------------------


class _Splits:
    """Gains of all splits of nodes from their sums by bin, columns side by side."""

    def __init__(self, plan: Plan, columns: Sequence[Binned]):
        own = [columns[c] for c in plan.columns]
        sizes = [c.bins for c in own]
        self.plan = plan
        self.starts = np.cumsum([0, *sizes[:-1]])
        self.first = slice(0, sizes[0])
        self.of = np.repeat(np.arange(len(own)), sizes)
        self.level = np.repeat([c.levels is not None for c in own], sizes)
        last = np.zeros(len(self.of), bool)
        last[np.cumsum(sizes) - 1] = True
        self.never = last & ~self.level

    def place(self, k: int) -> tuple[int, int]:
        """Column and code of a split."""
        return self.plan.columns[self.of[k]], int(k - self.starts[self.of[k]])

    def number(self, column: int, code: int) -> int:
        return int(self.starts[self.plan.columns.index(column)] + code)

    def gains(self, both: np.ndarray, scale: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gain, low sum, low count) by node and split of [nodes, 2, bins]; a gain of -1 is no split."""
        upto = np.cumsum(both, axis=2)
        before = (upto - both)[:, :, self.starts][:, :, self.of]
        low = np.where(self.level, both, upto - before)
        all_ = both[:, :, self.first].sum(axis=2)
        total, n = all_[:, :1], all_[:, 1:]
        low, n_low = low[:, 0], low[:, 1]
        high, n_high = total - low, n - n_low
        p = self.plan.penalty
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = low.astype(float) ** 2 / (n_low + p) + high.astype(float) ** 2 / (n_high + p) - total.astype(float) ** 2 / (n + p)
        ok = (n_low >= least) & (n_high >= least) & ~self.never
        return np.where(ok, gain / (scale * scale), -1.0), low, n_low


class _Sample:
    """Rows that proposals are grown on, with every model's residuals."""

    def __init__(self, block: Block, plans: Sequence[Plan], splits: Sequence[_Splits], rows: int):
        self.block, self.wide = block, []
        self.share = min(1.0, SAMPLE / max(1, rows))  # of the rows, that a proposal sees
        self.seen = [np.arange(len(block.y)) if p.out is None else np.flatnonzero(block.fold != p.out) for p in plans]
        for p, s in zip(plans, splits):
            self.wide.append(np.stack([block.codes[c].astype(np.int64) + s.starts[i] for i, c in enumerate(p.columns)], axis=1))

    def turn(self, model: int, number: int) -> np.ndarray:
        """The rows that this round's tree of a model is proposed on."""
        seen = self.seen[model]
        if len(seen) <= SAMPLE:
            return seen
        return np.sort(np.take(seen, np.arange(SAMPLE) + number * (SAMPLE + 7919), mode="wrap"))

    def sums(self, model: int, whole: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
        keys = self.wide[model][at]
        return np.array([
            np.bincount(keys.ravel(), np.repeat(whole[at], keys.shape[1]), bins), np.bincount(keys.ravel(), minlength=bins)]).astype(np.int64)


class _Growth:
    """One tree while it grows: sums of its nodes on all rows, and the splits that stand."""

    def __init__(self, plan: Plan, model: int, splits: _Splits, sample: _Sample, scale: float, is_level: Sequence[bool], number: int):
        self.plan, self.model, self.splits, self.sample, self.scale, self.is_level = plan, model, splits, sample, scale, is_level
        self.tree, self.depth, self.parent = Tree(), {0: 0}, {}
        self.sums: dict[int, np.ndarray] = {}
        self.known: dict[int, tuple[int, int]] = {}  # sum and count of a node on all rows
        self.best: dict[int, tuple] = {}  # of a summed node: gain, split, low sum, low count of what stands
        self.whole = np.rint(sample.block.left_over[model] * scale)
        self.done, self.gained, self.lost = False, 0.0, 0.0
        self.rows = sample.turn(model, number)
        rest = sample.block.left_over[model][self.rows]
        self.tie = plan.tie * float(rest @ rest) / sample.share if len(rest) else 0.0
        self.roots: list[int] = [0]
        self.wanted = self._proposed()

    def _split(self, node: int, column: int, code: int, gain: float = 0.0) -> int:
        left = self.tree.split(node, column, code, gain)
        for child in (left, left + 1):
            self.parent[child], self.depth[child] = node, self.depth[node] + 1
        return left

    # -- proposals

    def _proposed(self) -> tuple[int, ...]:
        """Grow below the roots on the sample; the leaves there, which are to be summed."""
        bins, roots = len(self.splits.of), set(self.roots)
        rows = dict.fromkeys(self.roots, self.rows[:0])  # some may hold no row of the sample
        rows.update((n, at) for n, at in self.tree.visits(self.sample.block.codes, self.is_level, self.rows) if n in roots)
        sums = {n: self.sample.sums(self.model, self.whole, at, bins) for n, at in rows.items()}
        grow = self._symmetric_proposal if self.plan.symmetric else self._best_first_proposal
        grow(rows, sums)
        return tuple(n for n in self._below() if self.tree.column[n] < 0)

    def _below(self) -> list[int]:
        """The roots and all nodes below them, parents first."""
        out = list(self.roots)
        for node in out:
            if self.tree.column[node] >= 0:
                out += [self.tree.left[node], self.tree.left[node] + 1]
        return out

    def _sample_gains(self, sums: Sequence[np.ndarray]) -> np.ndarray:
        return self.splits.gains(np.array(sums), self.scale, max(1.0, self.plan.least * self.sample.share))[0]

    def _parted(self, node: int, left: int, rows: dict, sums: dict) -> None:
        """Rows and sums of both children on the sample: those of the larger are its parent's minus the smaller's."""
        column, at = self.tree.column[node], rows[node]
        x = self.sample.block.codes[column][at]
        low = x == self.tree.code[node] if self.is_level[column] else x <= self.tree.code[node]
        rows[left], rows[left + 1] = at[low], at[~low]
        small = left if len(rows[left]) <= len(rows[left + 1]) else left + 1
        other = left + 1 if small == left else left
        sums[small] = self.sample.sums(self.model, self.whole, rows[small], len(self.splits.of))
        sums[other] = sums[node] - sums[small]

    def _best_first_proposal(self, rows: dict, sums: dict) -> None:
        order: list = []
        made = 0

        def consider(nodes):
            nodes = [n for n in nodes if self.depth[n] < self.plan.depth and len(rows[n]) > 1]
            if nodes:
                gains = self._sample_gains([sums[n] for n in nodes])
                for row, n in zip(gains, nodes):
                    k = int(np.argmax(row))
                    if row[k] > 0:
                        heapq.heappush(order, (-row[k], n, k))

        consider(list(rows))
        while order and made < self.plan.leaves * 5 // 4:
            _, node, k = heapq.heappop(order)
            left = self._split(node, *self.splits.place(k))
            self._parted(node, left, rows, sums)
            consider((left, left + 1))
            made += 1

    def _symmetric_proposal(self, rows: dict, sums: dict) -> None:
        level = sorted(rows)
        while level and self.depth[level[0]] < self.plan.depth:
            gains = np.maximum(self._sample_gains([sums[n] for n in level]), 0).sum(axis=0)
            k = int(np.argmax(gains))
            if gains[k] <= 0:
                break
            below = []
            for node in level:
                left = self._split(node, *self.splits.place(k))
                self._parted(node, left, rows, sums)
                below += [left, left + 1]
            level = below

    # -- what stands on all rows

    def take(self, found: np.ndarray) -> None:
        """Sums of the wanted leaves, and of the nodes above them up to the roots."""
        self.sums.update((n, found[:, i]) for i, n in enumerate(self.wanted))
        fresh = self._below()
        for node in reversed(fresh):
            if self.tree.column[node] >= 0:
                left = self.tree.left[node]
                self.sums[node] = self.sums[left] + self.sums[left + 1]
            self.known[node] = tuple(int(x) for x in self.sums[node][:, self.splits.first].sum(axis=1))
        gains, low, n_low = self.splits.gains(np.array([self.sums[n] for n in fresh]), self.scale, max(1, self.plan.least))
        of = {n: i for i, n in enumerate(fresh)}
        if self.plan.symmetric:
            again = self._symmetric(fresh, of, gains, low, n_low)
        else:
            for n in fresh:
                self._settle(n, gains[of[n]], low[of[n]], n_low[of[n]])
            again = self._best_first()
        if not again:
            return self._finish()
        self.roots = [c for pair in again for c in pair]
        self.wanted = self._proposed()

    def _noise(self, node: int) -> float:
        """What a split of equal residuals may seem to gain by rounding."""
        total, n = self.known[node]
        return 1e-12 * (total / self.scale) ** 2 / max(1, n)

    def _spared(self, best: float, proposed: float) -> bool:
        """Whether a proposed split ties with the best, or the tree gives up no more than the slack with it."""
        if best - proposed <= self.tie:
            return True
        lost = self.lost + best - proposed
        if lost > self.plan.slack * (self.gained + best):
            return False
        self.lost = lost
        self.gained += best
        return True

    def _stands(self, node: int, k: int, gain: float, low, n_low) -> None:
        self.best[node] = (float(gain), *self.splits.place(k), (int(low[k]), int(n_low[k])))

    def _settle(self, node: int, gains: np.ndarray, low: np.ndarray, n_low: np.ndarray) -> None:
        """The split of a summed node: the proposed one if it is good enough, else the best."""
        k = int(np.argmax(gains))
        if gains[k] <= self._noise(node):
            self.tree.column[node] = -1
            return
        if self.tree.column[node] >= 0:
            proposed = self.splits.number(self.tree.column[node], self.tree.code[node])
            if gains[proposed] > self._noise(node) and self._spared(gains[k], gains[proposed]):
                return self._stands(node, proposed, gains[proposed], low, n_low)
            self.tree.column[node] = -1
        self._stands(node, k, gains[k], low, n_low)

    def _open(self, node: int) -> int:
        """The children of a node whose split stands; they are made if the split is not the proposed one."""
        gain, column, code, (total, n) = self.best[node]
        if self.tree.column[node] < 0:
            self._split(node, column, code)
        self.tree.gain[node] = gain
        left = self.tree.left[node]
        every = self.known[node]
        self.known[left], self.known[left + 1] = (total, n), (every[0] - total, every[1] - n)
        return left

    def _best_first(self) -> list[tuple[int, int]]:
        """Split the nodes that growth by the best leaf reaches with what is known; the pairs of
        children that have to be summed before it can go on."""
        order = [(-self.best[0][0], 0)] if 0 in self.best else []
        self.chosen, waiting = set(), []
        while order and len(self.chosen) < self.plan.leaves - 1:
            _, node = heapq.heappop(order)
            self.chosen.add(node)
            left = self._open(node)
            if self.depth[left] >= self.plan.depth:
                continue
            able = [c for c in (left, left + 1) if self.known[c][1] >= 2 * max(1, self.plan.least)]
            if able and left not in self.sums and self.best[node][0] > self.tie:
                waiting.append((left, left + 1))
            for child in able:
                if child in self.best:
                    heapq.heappush(order, (-self.best[child][0], child))
        return waiting

    def _symmetric(self, fresh: list[int], of: dict, gains: np.ndarray, low: np.ndarray, n_low: np.ndarray) -> list[tuple[int, int]]:
        """The levels whose split stands; the pairs of the next one if its parents' split is new."""
        self.chosen = getattr(self, "chosen", set())
        depth = min(self.depth[n] for n in fresh)
        level = sorted(n for n in fresh if self.depth[n] == depth)
        while level and self.depth[level[0]] < self.plan.depth:
            at = [of[n] for n in level]
            total = np.maximum(gains[at], 0).sum(axis=0)
            k = int(np.argmax(total))
            if total[k] <= sum(map(self._noise, level)):
                break
            same = False
            if self.tree.column[level[0]] >= 0:
                proposed = self.splits.number(self.tree.column[level[0]], self.tree.code[level[0]])
                same = self._spared(total[k], total[proposed])
                k = proposed if same else k
            below = []
            for n, i in zip(level, at):
                if not same:
                    self.tree.column[n] = -1
                self._stands(n, k, max(0.0, gains[i, k]), low[i], n_low[i])
                self.chosen.add(n)
                left = self._open(n)
                below += [left, left + 1]
            if self.depth[below[0]] < self.plan.depth and below[0] not in of:
                return list(zip(below[::2], below[1::2]))
            level = below
        return []

    def _finish(self) -> None:
        """The tree of the chosen splits with its leaf values; what was only proposed is left out."""
        kept, out, waiting = Tree(), {0: 0}, [0]
        while waiting:
            node = waiting.pop(0)
            if node in self.chosen:
                left, was = kept.split(out[node], self.tree.column[node], self.tree.code[node], self.tree.gain[node]), self.tree.left[node]
                out[was], out[was + 1] = left, left + 1
                waiting += [was, was + 1]
            elif (total := self.known[node])[1]:
                kept.value[out[node]] = self.plan.rate * total[0] / self.scale / (total[1] + self.plan.penalty)
        self.tree, self.done, self.wanted, self.sums = kept, True, (), {}


# ---- training -----------------------------------------------------------------------


@dataclass
class Fitted:
    """A model of a training, and its errors on the rows it saw and on those of the fold left out:
    (rows, sum of squared errors, sum of absolute errors, sum of squares about the mean)."""

    plan: Plan
    base: float
    trees: list[Tree]
    seen: tuple[int, float, float, float]
    held: tuple[int, float, float, float]


#: A block of the binned table as a row; ``place`` numbers the blocks, for good as they are written once.
WRITTEN = "place long, codes array<binary>, y binary, fold binary"


def _written(df: DataFrame, columns: Sequence[Binned], target: str, fold: str | None) -> tuple[DataFrame, int, int]:
    """The binned table, written once: blocks of at most ``BLOCK`` rows, the number of rows, and in how
    many partitions it should be worked on."""
    spark = df.sparkSession
    importable(spark)
    rows = df.where(col(target).isNotNull() & ~F.isnan(col(target).cast("double")))
    rows = rows.select(*_read(columns), col(target).cast("double").alias("__y"), (col(fold).cast("int") if fold else F.lit(-1)).alias("__fold"))
    n, cores = rows.count(), spark.sparkContext.defaultParallelism
    parts = max(1, -(-n // BLOCK), min(cores, n // LEAST_BLOCK))
    if cores < parts <= 4 * cores:
        parts = -(-parts // cores) * cores  # as many blocks for every core
    if parts != rows.rdd.getNumPartitions() and parts <= 4 * cores:
        rows = rows.repartition(parts)  # a large table stays as it is read
    sources = list(dict.fromkeys(c.source for c in columns))

    def pack(batches):
        held, size = [], 0
        places = itertools.count(TaskContext.get().partitionId() << 24)

        def emit(table):
            table = table.combine_chunks()
            by = {s: table[s].combine_chunks() if table[s].num_chunks != 1 else table[s].chunk(0) for s in sources}
            codes = [c.codes(by[c.source]) for c in columns]
            y = np.asarray(table["__y"]).astype(np.float64)
            fold = np.asarray(table["__fold"].fill_null(-1)).astype(np.int16)
            return pa.RecordBatch.from_arrays(
                [pa.array([next(places)]), pa.array([[c.tobytes() for c in codes]], pa.list_(pa.binary())), pa.array([y.tobytes()]), pa.array([fold.tobytes()])],
                names=["place", "codes", "y", "fold"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            while size >= BLOCK:
                table = pa.Table.from_batches(held)
                yield emit(table.slice(0, BLOCK))
                rest = table.slice(BLOCK)
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield emit(pa.Table.from_batches(held))

    made = staged(rows.mapInArrow(pack, WRITTEN), "binned")
    return made, n, parts if parts <= 4 * cores else 0


def _blocks(df: DataFrame, columns: Sequence[Binned], target: str, fold: str | None) -> tuple[RDD, int]:
    """The binned table's blocks as (codes, folds, targets), and the number of rows."""
    made, n, parts = _written(df, columns, target, fold)
    kinds = [np.uint8 if c.bins <= 256 else np.uint16 for c in columns]

    def opened(row):
        codes = [np.frombuffer(b, k) for b, k in zip(row.codes, kinds)]
        return codes, np.frombuffer(row.fold, np.int16), np.frombuffer(row.y, np.float64)

    if made.rdd.getNumPartitions() < parts:
        made = made.repartition(parts)
    return made.rdd.map(opened), n


def _scale(largest: float, n: int) -> float:
    """The power of two that residuals are multiplied by before they are rounded and summed: sums
    within a block stay exact in a double, those of all rows in 64 bits."""
    most = max(largest, 1e-300) * 4
    return 2.0 ** np.floor(min(np.log2(2.0**52 / (min(n, BLOCK) * most)), np.log2(2.0**61 / (n * most))))


def _gathered(sums: RDD, spark: SparkSession) -> list | None:
    """Element-wise sum of one list of arrays a partition."""
    parts = sums.getNumPartitions()
    slim = sums.map(_packed)
    if parts > DIRECT:
        return _opened(slim.treeReduce(lambda a, b: _packed(_added(_opened(a), _opened(b))), 2 if parts <= 4096 else 3))
    total = None
    for part in map(_opened, slim.collect()):
        total = part if total is None else _added(total, part)
    return total


def _drawn(blocks: RDD, n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Codes, folds and targets of the ``POOL`` rows of smallest hash, which do not depend on how the rows lie."""

    def smallest(parts: Sequence[tuple]) -> tuple:
        hashes, codes, fold, y = (np.concatenate(x, axis=-1) for x in zip(*parts))
        order = np.lexsort((fold, y, hashes))[:POOL]
        return hashes[order], codes[:, order], fold[order], y[order]

    def work(items):
        out = None
        for codes, fold, y in items:
            both = np.stack([c.astype(np.uint16) for c in codes]) if codes else np.zeros((0, len(y)), np.uint16)
            h = np.ascontiguousarray(y).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)
            for c in [*both, fold]:
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c.astype(np.uint64)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            near = h <= np.uint64(min(1.0, 2 * POOL / n) * float(2**64 - 2**11)) if n > 2 * POOL else np.ones(len(h), bool)
            part = smallest([(h[near], both[:, near], fold[near], y[near])])
            out = part if out is None else smallest([out, part])
        if out is not None:
            yield out

    found = blocks.mapPartitions(work)
    if found.getNumPartitions() <= DIRECT:
        _, codes, fold, y = smallest(found.collect())
    else:
        _, codes, fold, y = found.treeReduce(lambda a, b: smallest([a, b]))
    return list(codes), fold, y


def _totals(blocks: RDD, plans: Sequence[Plan], scale: float, spark: SparkSession) -> list:
    """Whole-number sum of the targets each model sees, and their number."""

    def work(items):
        out = [np.zeros(2, np.int64) for _ in plans]
        for _, fold, y in items:
            whole = np.rint(y * scale)
            for i, p in enumerate(plans):
                seen = whole if p.out is None else whole[fold != p.out]
                out[i] += np.array([int(seen.sum()), len(seen)])
        yield out

    return _gathered(blocks.mapPartitions(work), spark)


def _spreads(blocks: RDD, plans: Sequence[Plan], bases: Sequence[float], spark: SparkSession) -> list:
    """For every model the number of rows it sees and of the others, and their squares about the mean: [2, 3] of
    number, sum and sum of squares about the model's base."""

    def work(items):
        out = [np.zeros((2, 3)) for _ in plans]
        for _, fold, y in items:
            for i, p in enumerate(plans):
                seen = np.ones(len(y), bool) if p.out is None else fold != p.out
                for side, rows in ((0, seen), (1, ~seen)):
                    own = y[rows] - bases[i]
                    out[i][side] += (len(own), own.sum(), (own * own).sum())
        yield out

    return _gathered(blocks.mapPartitions(work), spark)


def train(df: DataFrame, columns: Sequence[Binned], target: str, plans: Sequence[Plan], fold: str | None = None) -> list[Fitted]:
    """Grow all the planned models side by side on the rows with a target."""
    spark = df.sparkSession
    shared_dir(spark)
    given, n = _blocks(df, columns, target, fold)
    if not n:
        none = (0, 0.0, 0.0, 0.0)
        return [Fitted(p, 0.0, [], none, none) for p in plans]
    given = given.persist(StorageLevel.MEMORY_AND_DISK)
    largest = given.map(lambda b: float(np.abs(b[2]).max())).max()
    scale = _scale(largest, n)
    bases = [float(s) / scale / c if c else 0.0 for s, c in (t.tolist() for t in _totals(given, plans, scale, spark))]
    scale /= 2  # residuals may be twice as large as targets
    is_level, bins = [c.levels is not None for c in columns], [c.bins for c in columns]
    folds = any(p.out is not None for p in plans)

    def begun(b) -> Block:
        return Block(b[0], b[1] if folds else b[1][:0].copy(), b[2][:0].copy(), [b[2] - base for base in bases])

    state = given.map(begun).persist(StorageLevel.MEMORY_AND_DISK)
    splits = [_Splits(p, columns) for p in plans]
    spreads = _spreads(given, plans, bases, spark)
    codes, fold_of, y = _drawn(given, n)
    sample = _Sample(Block(codes, fold_of, y, [y - base for base in bases]), plans, splits, n)
    trees: list[list[Tree]] = [[] for _ in plans]
    since: list[list[Tree]] = [[] for _ in plans]
    older: list[RDD] = [given]
    saved: str | None = None
    updates = 0
    for number in range(max((p.rounds for p in plans), default=0)):
        growing = {i: _Growth(p, i, splits[i], sample, scale, is_level, number) for i, p in enumerate(plans) if number < p.rounds}
        while todo := [i for i, g in growing.items() if not g.done]:
            tasks = [(i, Task(plans[i], scale, tuple(since[i]), growing[i].tree, growing[i].wanted)) for i in todo]

            def work(blocks, tasks=tasks):
                total = None
                for block in blocks:
                    made = [_summed(block, t, _updated(block, i, t.apply, is_level), is_level, bins) for i, t in tasks]
                    total = made if total is None else _added(total, made)
                if total is not None:
                    yield total

            for i, found in zip(todo, _gathered(state.mapPartitions(work), spark)):
                growing[i].take(found)
        for i, g in growing.items():
            trees[i].append(g.tree)
            since[i].append(g.tree)
            sample.block.left_over[i] = _updated(sample.block, i, [g.tree], is_level)
        if (number + 1) % ADVANCE == 0:
            now, since = since, [[] for _ in plans]

            def advance(block, now=now):
                return replace(block, left_over=[_updated(block, i, t, is_level) for i, t in enumerate(now)])

            older.append(state)
            state = state.map(advance).persist(StorageLevel.MEMORY_AND_DISK)
            updates += 1
            if updates % CUT == 0:
                state.checkpoint()
                state.count()
                saved = _forget(spark, saved, state)
                while older:
                    older.pop().unpersist()
            while len(older) > 1:  # the one before is read until the new one is there
                older.pop(0).unpersist()
    out = _errors(state, plans, since, is_level, spreads, spark)
    for rdd in [*older, state]:
        rdd.unpersist()
    _forget(spark, saved, None)
    return [Fitted(p, bases[i], trees[i], *out[i]) for i, p in enumerate(plans)]


def _forget(spark: SparkSession, saved: str | None, state: RDD | None) -> str | None:
    """Delete the checkpoint that a newer one replaces; the newer one's file."""
    if saved is not None:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(saved)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return state.getCheckpointFile() if state is not None else None


def _errors(state: RDD, plans: Sequence[Plan], since: Sequence[Sequence[Tree]], is_level: Sequence[bool], spreads: Sequence[np.ndarray], spark: SparkSession) -> list:
    """For every model the sums of ``Fitted`` on both sides."""

    def work(blocks):
        out = [np.zeros((2, 2)) for _ in plans]
        for block in blocks:
            for i, p in enumerate(plans):
                rest = _updated(block, i, since[i], is_level)
                seen = np.ones(len(rest), bool) if p.out is None else block.fold != p.out
                for side, rows in ((0, seen), (1, ~seen)):
                    r = rest[rows]
                    out[i][side] += ((r * r).sum(), np.abs(r).sum())
        yield out

    found = []
    for sums, spread in zip(_gathered(state.mapPartitions(work), spark), spreads):
        found.append(tuple((int(n), sse, sae, yy - y * y / n if n else 0.0) for (sse, sae), (n, y, yy) in zip(sums.tolist(), spread.tolist())))
    return found


# ---- models by feature list ---------------------------------------------------------


def plain_columns(df: DataFrame, spec: FeatureSpec, categories: bool = True) -> list[Binned]:
    """Numbers and booleans cut into bins, categories as their levels."""
    numbers = [*spec.numerics, *spec.booleans]
    cuts = number_cuts(df.select(*[col(c).cast("double").alias(c) for c in numbers]), numbers)
    out = [Binned(n, n, cuts=cuts[n]) for n in numbers]
    if categories and spec.categoricals:
        levels = vocabulary(df, spec.categoricals)
        out += [Binned(c, c, levels=tuple(levels[c])) for c in spec.categoricals]
    return out


def _ensemble(columns: Sequence[Binned], fitted: Fitted, encoded: Mapping[str, DataFrame] = {}, defaults: Mapping[str, float] = {}) -> Ensemble:
    """The model with only its own columns, under the names that tables to be scored have."""
    place = {c: i for i, c in enumerate(fitted.plan.columns)}
    trees = [replace(t, column=[place.get(c, -1) if c >= 0 else -1 for c in t.column]) for t in fitted.trees]
    own = [columns[c] for c in fitted.plan.columns]
    own = [replace(c, source=f"{c.parent}__o") if c.parent in encoded else c for c in own]
    return Ensemble(own, fitted.base, trees, dict(encoded), dict(defaults))


@dataclass(frozen=True)
class Boosting:
    """Parameters of a boosted model; ``ordered`` encodes categories by ordered target means, ``slack``
    and ``tie`` are shares of a tree's gain and of the squared error that proposed splits may give up."""

    rounds: int = 500
    rate: float = 0.05
    depth: int = 8
    leaves: int = 31
    least: int = 20
    penalty: float = 0.0
    symmetric: bool = False
    ordered: bool = False
    slack: float = 0.05
    tie: float = 0.001


def fit_folds(
    df: DataFrame, spec: FeatureSpec, kinds: Mapping[str, Boosting], fold: str | None = None, folds: Sequence[int] = (),
    key: Sequence[str] = (), seed: int = 42,
) -> dict[tuple[str, int | None], tuple[Ensemble, Fitted]]:
    """Every kind of model for every fold left out (or, without folds, on all rows), in shared passes.

    Binning does not look at the target and uses all rows.  Ordered target means of a model use the
    rows it sees; rows of the fold left out get the means over all of those.
    """
    outs: list[int | None] = [int(k) for k in folds] or [None]
    columns = plain_columns(df, spec)
    numbers = len(spec.numerics) + len(spec.booleans)
    means: dict[int | None, dict[str, DataFrame]] = {}
    priors: dict[int | None, float] = {}
    table = df
    encoded: dict[tuple[int | None, str], int] = {}
    if spec.categoricals and any(b.ordered for b in kinds.values()):
        table = staged(
            ordered_target_encode(df, spec.categoricals, spec.target, key or spec.columns, seed, fold=fold if folds else None, folds=[k for k in outs if k is not None]),
            "ordered")
        names = {(k, c): f"{c}__o" if k is None else f"{c}__o{k}" for k in outs for c in spec.categoricals}
        cuts = number_cuts(table, list(names.values()))
        for (k, c), name in names.items():
            encoded[k, c] = len(columns)
            columns.append(Binned(name, c, cuts=cuts[name]))
        for k in outs:
            seen = df if k is None else df.where(~col(fold).eqNullSafe(F.lit(k)))
            priors[k], means[k] = full_target_means(seen, spec.categoricals, spec.target)
    plans = []
    for name, b in kinds.items():
        for k in outs:
            own = [*range(numbers)]
            own += [encoded[k, c] for c in spec.categoricals] if b.ordered else [numbers + i for i in range(len(spec.categoricals))]
            plans.append(Plan(name, tuple(own), b.rounds, b.rate, b.depth, b.leaves, b.least, b.penalty, b.symmetric, b.slack, b.tie, k))
    used = sorted({c for p in plans for c in p.columns})  # others are not carried through the passes
    columns = [columns[c] for c in used]
    plans = [replace(p, columns=tuple(used.index(c) for c in p.columns)) for p in plans]
    out = {}
    for f in train(table, columns, spec.target, plans, fold if folds else None):
        k, b = f.plan.out, kinds[f.plan.name]
        with_means = means.get(k, {}) if b.ordered else {}
        out[f.plan.name, k] = (_ensemble(columns, f, with_means, {c: priors[k] for c in with_means}), f)
    return out
