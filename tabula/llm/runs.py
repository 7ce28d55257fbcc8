"""Arrow helpers: rows of one key as one numpy run inside a partition, without a Python call per group in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabula.llm.common import arrow_pass


def by_runs(df: DataFrame, keys: list[str], tasks: int, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, order: list[str] = ()) -> DataFrame:
    """Shuffle by ``keys`` (long columns), sort inside the partitions, call ``fn`` with whole groups.

    ``fn`` gets a table of one or more complete groups (as many as arrived in a batch), so small groups share a
    call and only a group larger than an Arrow batch is put together from several.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            last = [b.column(k)[b.num_rows - 1] for k in keys]
            cut = b.num_rows
            same = np.ones(b.num_rows, bool)
            for k, v in zip(keys, last):
                same &= b.column(k).to_numpy(zero_copy_only=False) == v.as_py()
            cut = int(np.argmax(same)) if same.any() else cut  # rows of the last key start here (sorted)
            if cut == 0 and held:
                first = [held[-1].column(k)[held[-1].num_rows - 1] for k in keys]
                if [x.as_py() for x in first] != [x.as_py() for x in last]:
                    yield from fn(pa.Table.from_batches(held))
                    held = []
            elif cut:
                yield from fn(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from fn(pa.Table.from_batches(held))

    return arrow_pass(df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order), run, schema)


def bounds(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def numpy_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
