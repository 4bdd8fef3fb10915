"""Shared helpers: one key per document, global positions, bounded broadcasts, bytes of texts.

Every helper keeps rows distributed.  ``keyed`` gives the document key the operators work
with; ``positioned`` numbers rows globally without one task ever holding them all.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tilth.session import staged

#: A side of a join is broadcast up to so many rows of fixed width; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows of a batch that goes to a task's Python worker.
BATCH_ROWS = 2_000
#: Bytes of text that one vectorised step works on at a time.
SEGMENT_BYTES = 1 << 19


def positioned(df: DataFrame, order: list, name: str, label: str = "positions", finer: int = 1) -> DataFrame:
    """Add ``name``, the row's place (from 0) in the order of ``order``, over the whole table.

    The rows are dealt by range and sorted inside their partitions; the partitions' row
    counts (one small row each) are added up to give every partition its first place.
    Order by enough columns to tell rows apart: equal rows take neighbouring places.
    ``finer`` makes so many times the session's partitions, for rows of very unequal bytes.
    """
    parts = finer * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = "__line"
    placed = staged(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(line, F.monotonically_increasing_id()),
        label,
    ).withColumn("__part", F.shiftright(F.col(line), 33))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__base"))
    local = F.col(line).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(bases), "__part").withColumn(name, F.col("__base") + local).drop(line, "__part", "__base")


def keyed(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """(key, id, text, row) of a table of documents, a null text as empty and ``row`` with all
    columns; and whether keys are ids.

    Where ids are neither null nor repeated the key is the id.  Otherwise it is the row's
    place in the order of id (null last) and text, so that keys are unique and follow ids.
    """
    slim = docs.select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct("*").alias("row"))
    odd = slim.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL")
    if odd.isEmpty():
        return slim.select(F.col("id").alias("key"), "id", "text", "row"), True
    order = [F.col("id").asc_nulls_last(), F.col("text")]
    return positioned(slim, order, "key", "keys").select("key", "id", "text", "row"), False


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (joined by shuffle)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: What a worker process keeps from task to task: the one compiled model in use.
_KEPT: dict = {}


def kept(key, make: Callable):
    """``make()``, once for each worker process and key while tasks of the same kind follow each other."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def make_room(keeps: bool) -> None:
    """Give back what a worker process, which outlives its tasks, need not hold."""
    if not keeps:
        _KEPT.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def in_tasks(df: DataFrame, work: Callable, schema, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` whose workers find this package where the driver found it, if they share the path.

    Rows may be whole documents, so the session's batches are cut to ``BATCH_ROWS``: they
    stand several times in a task's memory, on both sides of the pipe.  ``keeps`` says that
    the tasks use a ``kept`` model; others make room.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = df.sparkSession.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])

    def released(batches):
        make_room(keeps)
        yield from work(batches)
        make_room(keeps)

    return df.mapInArrow(released, schema)


# ---- bytes of texts, inside tasks -------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and the offsets of its rows."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def segments(column: pa.Array, limit: int = SEGMENT_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    data, at = text_bytes(column)
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of a number modulo 2**64, longer on demand."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = np.uint64(pow(self.base, len(self.known), 1 << 64))
            self.known = np.concatenate([self.known, self.known * step])
        return self.known[:n]


POWERS, INVERSES = _Powers(_BASE), _Powers(_INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``hash_of`` takes the hash of any byte range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS.upto(len(data)), out=out[1:])
    return out


def hash_of(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) of each pair, the same wherever the bytes stand."""
    return mixed((prefix[ends] - prefix[starts]) * INVERSES.upto(len(prefix))[starts])


def grams_of(prefix: np.ndarray, size: int) -> np.ndarray:
    """``hash_of`` for every run of ``size`` bytes."""
    return mixed((prefix[size:] - prefix[:-size]) * INVERSES.upto(len(prefix))[: len(prefix) - size])


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space); no word crosses a row."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    full = at[:-1][at[1:] > at[:-1]]
    starts[full] = word[full]
    lasts = at[1:][at[1:] > at[:-1]] - 1
    ends[lasts] = word[lasts]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return _LOWER[data]


def shingle_hashes(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle of ``width`` words; fewer words make one shingle, none make none."""
    starts, ends = word_bounds(data, at)
    words = hash_of(rolling(data), starts, ends)
    first = np.searchsorted(starts, at)
    sizes = np.diff(first)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(words)) - first[:-1][rows]
    reach = np.minimum(sizes[rows], width)
    begin = inside + reach <= sizes[rows]
    begin &= (sizes[rows] >= width) | (inside == 0)
    picked = np.flatnonzero(begin)
    out = mixed(reach[picked].astype(np.uint64))
    for j in range(width):
        live = reach[picked] > j
        out[live] = mixed(out[live] * np.uint64(0xD6E8FEB86659FD93) + words[picked[live] + j])
    return out, rows[picked]
