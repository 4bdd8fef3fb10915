"""Exact top-k by inner product: columnar branch and bound.

Vectors are kept in blocks, one column per dimension.  For a block of queries and a block of
candidates the products are added up over a few dimensions at a time, those with the largest
query components first.  What the remaining dimensions can still add is at most the product
of the remaining norms (Cauchy and Schwarz), so after each step every candidate whose bound
lies below the k-th best known lower bound is dropped and the columns are compacted.

Query blocks meet candidate blocks in a grid of cells; a cell is one row of a join and a task
holds one at a time.  Each cell gives at most k rows a query, so the last step, a window by
query, orders k rows for every candidate block and never all candidates.

Defined results: vectors that are null or empty or hold null, NaN or infinite components take no part,
neither do rows of null id; rows that repeat an id are candidates and queries of their own (a query is
no candidate of itself, but other rows of its id are); vectors of other lengths than the
query's are no candidates of it; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tilth.llm.base import in_tasks
from tilth.llm.blocks import matrix, packed, spread_over
from tilth.session import spread, staged

QUERIES = 512
CANDIDATES = 2048
#: Dimensions added up before the candidates are looked at again.
STEP = 8
#: Cells of the grid on the candidates' side, at most.
SALT = 64
#: Above this size of a component products may leave the whole numbers doubles hold exactly.
EXACT = float(1 << 22)


def quantized(lists: pa.Array, scale: float):
    """(rows, matrix) of floor(scale * x) of the vectors whose components are all finite."""
    for rows, found in matrix(lists):
        found = np.floor(scale * found)
        good = np.isfinite(found).all(axis=1)
        yield rows[good], found[good]


def _scores(query: np.ndarray, columns: np.ndarray) -> np.ndarray:
    if max(np.abs(query).max(initial=0), np.abs(columns).max(initial=0)) <= EXACT:
        return query @ columns
    return query.astype(np.int64).astype(object) @ columns.astype(np.int64).astype(object)


def best_of_block(query: np.ndarray, own: int, ids: np.ndarray, lines: np.ndarray, columns: np.ndarray, norms: np.ndarray, k: int) -> tuple:
    """(ids, scores) of the k best candidates of one query in a block of columns (dimension by row).

    ``lines`` number the rows of the table; the query's ``own`` is left out.  ``norms`` has the squared norms of the columns; those of the remaining dimensions are
    kept up by subtracting what has been added up.
    """
    live = np.flatnonzero(lines != own)
    if not len(live):
        return ids[:0], np.zeros(0)
    order = np.argsort(-np.abs(query), kind="stable")
    part, rest = np.zeros(len(live)), norms[live]
    tail = np.concatenate([np.cumsum((query[order] ** 2)[::-1])[::-1], [0.0]])
    for at in range(0, len(order), STEP):
        some = order[at : at + STEP]
        block = columns[np.ix_(some, live)]
        part = part + query[some] @ block
        rest = np.maximum(rest - (block * block).sum(axis=0), 0.0)
        if len(live) <= 4 * k:
            continue
        reach = np.sqrt(rest * tail[min(at + STEP, len(order))]) * (1 + 1e-9) + 1e-6
        bar = np.partition(part - reach, len(live) - k)[len(live) - k]
        stay = part + reach >= bar
        live, part, rest = live[stay], part[stay], rest[stay]
    score = _scores(query, columns[:, live])
    top = np.lexsort((ids[live], -score.astype(np.float64)))[:k] if score.dtype != object else np.array(
        sorted(range(len(live)), key=lambda i: (-score[i], ids[live[i]]))[:k], int)
    return ids[live][top], score[top]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every query the k best other vectors."""
    slim = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    made = [0]  # blocks of a task, for numbers that tell all blocks and rows apart

    def pack(table):
        for rows, found in quantized(table.column("vector"), scale):
            if found.size:
                made[0] += 1
                block = (TaskContext.get().partitionId() << 24) + made[0]
                ids, asks = table.column("id").to_numpy()[rows], table.column("asks").to_numpy(zero_copy_only=False)[rows]
                lines = block * CANDIDATES + np.arange(len(rows))
                yield [block, found.shape[1], ids.tobytes(), lines.tobytes(), np.ascontiguousarray(found.T).tobytes(), asks.tobytes()]

    shape = "block long, size int, ids binary, lines binary, columns binary"
    candidates = staged(packed(spread(slim), f"{shape}, asks binary", pack, CANDIDATES), "candidates")

    def asking(batches):
        for batch in batches:
            for size, ids, lines, columns, asks in zip(*(c.to_pylist() for c in batch.columns)):
                some = np.frombuffer(asks, bool)
                if some.any():
                    found = np.frombuffer(columns, np.float64).reshape(size, -1)[:, some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.frombuffer(x, np.int64)[some]) for x in (ids, lines)]
                        + [pa.ListArray.from_arrays(np.arange(0, found.size + 1, size, dtype=np.int32), pa.array(found.T.ravel()))],
                        names=["id", "line", "vector"])

    asked_rows = in_tasks(candidates.select("size", "ids", "lines", "columns", "asks"), asking, "id long, line long, vector array<double>")

    def again(table):
        for rows, found in matrix(table.column("vector")):
            ids, lines = (table.column(x).to_numpy()[rows] for x in ("id", "line"))
            yield [int(lines[0]), found.shape[1], ids.tobytes(), lines.tobytes(), np.ascontiguousarray(found.T).tobytes()]

    queries = staged(packed(asked_rows, shape, again, QUERIES), "queries")
    salt = min(SALT, -(-candidates.count() // 4) or 1)
    asked = queries.groupBy("size").agg(F.count("*").alias("many"))
    # numbered without the matrices, so that the one task of a size sorts a few numbers for each block
    numbers = queries.select("size", "block").withColumn("q", F.row_number().over(Window.partitionBy("size").orderBy("block")) - 1)
    numbered = queries.join(numbers, ["size", "block"])
    sides = spread_over(numbered, "salt", salt).select("size", "q", "salt", F.col("lines").alias("q_lines"), F.col("ids").alias("q_ids"), F.col("columns").alias("q_columns"))
    grid = candidates.drop("asks").join(asked, "size").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salt)).cast("int"))
    cells = spread_over(grid, "q", F.col("many")).join(sides, ["size", "q", "salt"])

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                size = batch.column(0)[row].as_py()
                ids, lines, q_ids, q_lines = (np.frombuffer(batch.column(i)[row].as_buffer(), np.int64) for i in (1, 2, 4, 5))
                columns, asks = (np.frombuffer(batch.column(i)[row].as_buffer(), np.float64).reshape(size, -1) for i in (3, 6))
                norms = (columns * columns).sum(axis=0)
                found = [best_of_block(asks[:, i], own, ids, lines, columns, norms, k) for i, own in enumerate(q_lines)]
                counts = [len(x) for x, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_lines, counts)), pa.array(np.repeat(q_ids, counts)), pa.array(np.concatenate([x for x, _ in found])),
                     pa.array([int(s) for _, x in found for s in x], pa.int64())], ["line", "query_id", "vec_id", "score"])

    given = cells.select("size", "ids", "lines", "columns", "q_ids", "q_lines", "q_columns")
    each = in_tasks(given, work, "line long, query_id long, vec_id long, score long")
    line = Window.partitionBy("line").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
