"""Vectors packed into blocks of bounded size, so that tasks work on matrices and never on a
whole group.  A block is one row: ids and a matrix of doubles as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tilth.llm.base import in_tasks

BLOCK = 1024


def matrix(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the lists of each length; null lists and lists with nulls are left out."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    good = np.asarray(lists.is_valid())
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    holes = np.asarray(values.is_null())
    if holes.any():
        of = np.repeat(np.arange(len(lists)), sizes)
        good[of[holes]] = False
    flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[good]):
        rows = np.flatnonzero(good & (sizes == size))
        yield rows, flat[starts[rows][:, None] + np.arange(size)]


def packed(df: DataFrame, columns: str, pack: Callable, block: int = BLOCK) -> DataFrame:
    """Rows packed block by block within their partitions.

    ``pack`` gets the Arrow table of a run of at most ``block`` rows and yields lists of
    values for ``columns``.
    """

    def work(batches):
        def emit(table: pa.Table):
            names = [c.split()[0] for c in columns.split(", ")]
            made = list(pack(table.combine_chunks()))
            if made:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*made)))), schema=schema)

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= block:
                yield from emit(held.slice(0, block))
                held = held.slice(block)
        if held is not None and held.num_rows:
            yield from emit(held)

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])
    return in_tasks(df, work, columns)


def spread_over(df: DataFrame, name: str, count) -> DataFrame:
    """Every row once for each number from 0 below ``count`` (a number or column) in ``name``."""
    last = (F.lit(count) if isinstance(count, int) else count) - 1
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("int"), last.cast("int"))))
