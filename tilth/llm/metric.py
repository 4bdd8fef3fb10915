"""Near-duplicates of vectors by an exact metric range join.

Vectors of a label are scaled to length one, where a cosine of at least c is a distance of
at most e = sqrt(2 - 2c).  Pivots split a label into cells: a vector's home is the cell of its
nearest pivot.  By the triangle inequality a vector within e of a home vector of cell j is at
most 2e farther from pivot j than from its own, so of two cells only such vectors are compared.
No vector is copied to other cells: every vector is written once, in a block of its cell, and
tasks go over pairs of blocks of a label, each pair once, for the links of both sides.  Blocks
are read again for every group of blocks they are paired with, so what is written grows
with the vectors and only what is read and multiplied grows with the pairs.

Equal vectors are one class and one row.  A task returns a number of links for each
vector and, of the links themselves, only as many as keep the blocks' components together.

Random vectors of many dimensions lie about as far from each other as from any pivot; then
the join nears all pairs of a label.  That is the price of exactness by this method; results
do not depend on it.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
vectors without a label, have no links and are their own component; vectors of different
lengths are not linked; rows with null or repeated ids are vectors of their own, in the
order of id (null last) and vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from tilth.llm.base import bounded, in_tasks, positioned
from tilth.llm.blocks import matrix
from tilth.llm.components import components
from tilth.session import staged

COSINE = 0.98
#: Vectors of a label for each pivot, and pivots altogether (the bound of what tasks are sent).
CELL = 2048
PIVOTS = 10_000
BLOCK = 2048
#: Bytes of blocks that a task pairs with as many others, and rows that it gathers before they are added up.
PAIRED, GATHERED = 16 << 20, 1 << 19
#: Added to distances that are compared, for their rounding.
SLACK = 1e-9


def _directed(lists: pa.Array):
    """(rows, vectors) of those that have a direction."""
    for rows, found in matrix(lists):
        peak = np.abs(found).max(axis=1, initial=0.0)
        good = np.isfinite(peak) & (peak > 0)
        yield rows[good], found[good]


def _scaled(found: np.ndarray) -> np.ndarray:
    """Vectors scaled to length one."""
    found = found / np.abs(found).max(axis=1, initial=0.0)[:, None]
    return found / np.sqrt((found * found).sum(axis=1))[:, None]


def units(lists: pa.Array):
    """(rows, vectors of length one) of the vectors that have a direction."""
    for rows, found in _directed(lists):
        yield rows, _scaled(found)


def _kind(vectors: DataFrame):
    """The type that holds a vector's numbers as the table has them: they are scaled where they are used."""
    return np.float32 if isinstance(vectors.schema["vector"].dataType.elementType, FloatType) else np.float64


def homes(found: np.ndarray, pivots: np.ndarray, reach: float):
    """(row, cell, is home) of each vector's home and of the cells whose vectors it can have links to."""
    for at in range(0, len(found), 512):
        some = found[at : at + 512]
        away = np.sqrt(np.maximum(2 - 2 * (some @ pivots.T), 0))
        home = away.argmin(axis=1)
        close = away <= away[np.arange(len(some)), home][:, None] + 2 * reach + SLACK
        row, cell = np.nonzero(close)
        yield row + at, cell, cell == home[row]


def _near(found: np.ndarray, own: np.ndarray, other: np.ndarray, reach: float) -> np.ndarray:
    """Which vectors at home with one pivot can have links to vectors at home with another."""
    return np.concatenate([row[cell == 1] for row, cell, _ in homes(found, np.stack([own, other]), reach)])


def _cells(classes: DataFrame, pivots: dict, reach: float) -> DataFrame:
    """(label, size, cell, id, weight, vector): every class with its home."""
    kind = _kind(classes)

    def work(batches):
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), object)
            for rows, raw in _directed(batch.column(3)):
                of, found = labels[rows], _scaled(raw)
                for label in set(of):
                    mine = np.flatnonzero(of == label)
                    own, size = found[mine], found.shape[1]
                    known = pivots.get((label, size))
                    cell = np.zeros(len(mine), np.int64)
                    for row, to, home in homes(own, known, reach) if known is not None else ():
                        cell[row[home]] = to[home]
                    at = pa.array(rows[mine])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label] * len(mine), pa.string()), pa.array(np.full(len(mine), size, np.int32)),
                         pa.array(cell.astype(np.int32)), batch.column(1).take(at),
                         batch.column(2).take(at), pa.array([x.tobytes() for x in raw[mine].astype(kind)], pa.binary())],
                        ["label", "size", "cell", "id", "weight", "vector"])

    return in_tasks(classes.select("label", "id", "weight", "vector"), work,
                    "label string, size int, cell int, id long, weight long, vector binary")


def _pivots(classes: DataFrame) -> dict:
    """Pivots of the labels that need more than one cell: (label, size) to a matrix, PIVOTS rows in all."""
    sizes = classes.groupBy("label", F.size("vector").alias("size")).agg(F.count("*").alias("many"))
    total = sizes.agg(F.sum("many")).first()[0] or 0
    each = max(CELL, -(-total // (PIVOTS // 2)))
    large = sizes.where(F.col("many") > each).withColumn("wanted", F.ceil(F.col("many") / each))
    drawn = (F.xxhash64("id", F.lit(7)).bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)) * F.col("many") < F.col("wanted")
    named = classes.withColumn("size", F.size("vector")).join(bounded(large), ["label", "size"]).where(drawn)
    found: dict = {}
    for row in named.select("label", "size", "id", "vector").orderBy("id").limit(PIVOTS).collect():
        for _, one in units(pa.array([row["vector"]], pa.list_(pa.float64()))):
            found.setdefault((row["label"], row["size"]), []).extend(one)
    return {k: np.array(v) for k, v in found.items()}


def _groups(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep the components of a block of links together: (id, smallest id) of every linked row."""
    rows, columns = np.nonzero(flags)
    if not len(rows):
        return rows, rows
    low_a, low_b = a.copy(), b.copy()
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    turned = np.argsort(columns, kind="stable")
    marks = np.flatnonzero(np.r_[True, columns[turned][1:] != columns[turned][:-1]])
    of_a, of_b = rows[starts], columns[turned][marks]
    while True:
        before = low_a[of_a].copy()
        low_a[of_a] = np.minimum(low_a[of_a], np.minimum.reduceat(low_b[columns], starts))
        low_b[of_b] = np.minimum(low_b[of_b], np.minimum.reduceat(low_a[rows[turned]], marks))
        if (before == low_a[of_a]).all():
            break
    return np.concatenate([a[of_a], b[of_b]]), np.concatenate([low_a[of_a], low_b[of_b]])


class _Found:
    """What a task has found: numbers of links of vectors, and links, added up from time to time."""

    def __init__(self):
        self.counts, self.links, self.rows = [], [], 0

    def add(self, flags: np.ndarray, a: tuple, b: tuple) -> None:
        """Links between the vectors of two blocks (ids, weights); a block with itself if they are the same."""
        sides = [(a[0], flags @ b[1])] + ([] if a is b else [(b[0], flags.T @ a[1])])
        for ids, many in sides:
            some = np.flatnonzero(many)
            self.counts.append((ids[some], many[some]))
        node, low = _groups(flags, a[0], b[0])
        moved = node != low
        self.links.append((node[moved], low[moved]))
        self.rows += len(self.counts[-1][0]) + len(node)

    def batch(self) -> pa.RecordBatch:
        ids, many = (np.concatenate(x) for x in zip(*self.counts))
        own, at = np.unique(ids, return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, at, many)
        node, low = np.unique(np.stack([np.concatenate(x) for x in zip(*self.links)]), axis=1)
        self.counts, self.links, self.rows = [], [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([own, node])), pa.array([None] * len(own) + low.tolist(), pa.int64()),
             pa.array(total.tolist() + [None] * len(node), pa.int64())], ["id", "other", "links"])


def _blocks(cells: DataFrame) -> DataFrame:
    """The vectors of a cell in blocks, each vector in one: (label, size, cell, parts, ids, weights, vectors, no);
    ``parts`` are the blocks of the label."""
    by = ["label", "size"]
    sizes = cells.groupBy(*by, "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("own"))
    parts = sizes.join(sizes.groupBy(*by).agg(F.sum("own").cast("int").alias("parts")), by)
    dealt = cells.join(bounded(parts), [*by, "cell"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("own")).cast("int"))
    shape = "label string, size int, cell int, parts int, ids binary, weights binary, vectors binary"

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fixed = [table.column(c)[0].as_py() for c in ("label", "size", "cell", "parts")]
        body = [table.column("id").to_numpy().tobytes(), table.column("weight").to_numpy().tobytes(), b"".join(table.column("vector").to_pylist())]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
        names = [c.split()[0] for c in shape.split(", ")]
        return pa.table([pa.array([x], t) for x, t in zip([*fixed, *body], kinds)], names=names)

    packed = dealt.groupBy("label", "size", "cell", "part").applyInArrow(pack, shape)
    return staged(packed.withColumn("no", F.monotonically_increasing_id()), "blocks")


def _paired(blocks: DataFrame) -> DataFrame | None:
    """Every two blocks of a label, once; None if no label has two.

    A product of partitions that asks for equal labels inside: a join by label would bring a label's
    blocks to one task, or copies of them to several."""
    many = blocks.where("parts > 1").select("no", "label", "size", "cell", "ids", "weights", "vectors")
    row = many.agg(F.count("*").alias("n"), F.sum(F.length("vectors")).alias("bytes")).first()
    if not row["n"]:
        return None
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    parts = min(row["n"], max(-(-row["bytes"] // PAIRED), 2 * int(np.ceil(np.sqrt(cores)))))
    many = many.repartition(parts).withColumn("named", F.xxhash64("label", "size"))
    left, right = (many.select(*[F.col(c).alias(f"{side}_{c}") for c in many.columns]) for side in "lr")
    # not an equality of two columns, which would be a join by label
    same = F.col("l_named").bitwiseXOR(F.col("r_named")) == 0
    return left.crossJoin(right).where(same & (F.col("l_no") < F.col("r_no")))


def _linked(blocks: DataFrame, pivots: dict, cosine: float, reach: float, kind) -> DataFrame:
    """(id, other, links): numbers of links (other null) and links (links null) found by the tasks."""

    def opened(batch: pa.RecordBatch, i: int, first: int) -> tuple:
        label, size, cell = (batch.column(first + j)[i].as_py() for j in range(3))
        ids, weights, vectors = (batch.column(first + j)[i].as_buffer() for j in range(3, 6))
        return label, size, cell, np.frombuffer(ids, np.int64), np.frombuffer(weights, np.int64), _scaled(np.frombuffer(vectors, kind).astype(np.float64).reshape(-1, size))

    def within(batches):
        found = _Found()
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, _, ids, weights, a = opened(batch, i, 0)
                flags = a @ a.T >= cosine
                np.fill_diagonal(flags, False)
                one = (ids, weights)
                found.add(flags, one, one)
                if found.rows > GATHERED:
                    yield found.batch()
        if found.counts:
            yield found.batch()

    def between(batches):
        found = _Found()
        for batch in batches:
            for i in range(batch.num_rows):
                (label, size, cell, ids, weights, a), (b_label, b_size, b_cell, b_ids, b_weights, b) = opened(batch, i, 0), opened(batch, i, 6)
                if (label, size) != (b_label, b_size):  # equal hashes
                    continue
                if cell != b_cell:
                    own, other = pivots[label, size][[cell, b_cell]]
                    some, b_some = _near(a, own, other, reach), _near(b, other, own, reach)
                    a, ids, weights, b, b_ids, b_weights = a[some], ids[some], weights[some], b[b_some], b_ids[b_some], b_weights[b_some]
                if len(a) and len(b):
                    found.add(a @ b.T >= cosine, (ids, weights), (b_ids, b_weights))
                if found.rows > GATHERED:
                    yield found.batch()
        if found.counts:
            yield found.batch()

    shape, columns = "id long, other long, links long", ["label", "size", "cell", "ids", "weights", "vectors"]
    out = in_tasks(blocks.select(*columns), within, shape)
    pairs = _paired(blocks)
    if pairs is None:
        return out
    return out.unionByName(in_tasks(pairs.select(*[f"{side}_{c}" for side in "lr" for c in columns]), between, shape))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding",
                 label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors``."""
    slim = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).cast("string").alias("label"))
    odd = slim.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL")
    plain = odd.isEmpty()
    if plain:
        rows = slim.withColumn("key", F.col("id"))
    else:
        rows = positioned(slim, [F.col("id").asc_nulls_last(), F.col("label"), F.col("vector")], "key", "vectors")
    good = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0) & F.forall(
        "vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    able = rows.where(good)
    classes = staged(
        able.groupBy("label", "vector").agg(F.min("key").alias("id"), F.count("*").alias("weight")), "vector-classes")
    reach = float(np.sqrt(max(2 - 2 * cosine, 0)))
    pivots = _pivots(classes)
    found = staged(_linked(_blocks(_cells(classes, pivots, reach)), pivots, cosine, reach, _kind(classes)), "vector-links")
    links = found.where("links IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.where("other IS NOT NULL"), "id", "other")
    each = (
        classes.select("label", "vector", F.col("id").alias("class"), "weight")
        .join(links.select(F.col("id").alias("class"), "links"), "class", "left")
        .join(parts.select(F.col("node").alias("class"), "component"), "class", "left")
        .select("label", "vector", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "class").alias("part"))
    )
    named = able.select("key", "id", "label", "vector").join(each, ["label", "vector"]).select("key", "id", "n_links", "part")
    rest = rows.where(~F.coalesce(good, F.lit(False))).select(
        "key", "id", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("part"))
    every = named.unionByName(rest)
    if plain:
        every = every.withColumn("component_id", F.col("part"))
    else:
        every = every.join(rows.select(F.col("key").alias("part"), F.col("id").alias("component_id")), "part")
    return every.select("id", "n_links", "component_id", (F.col("key") == F.col("part")).alias("kept"))
