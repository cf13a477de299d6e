"""Arrow batches of array columns as blocks of numpy, a few rows at a time; no Spark here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that are worked on, and sent back, at once; so a task's memory doesn't follow Spark's batches.
ROWS = 512


def pieces(batches, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, stacked arrays) of a list column, a length at a time, so that numpy works on whole blocks. Null elements are NaN, null lists in no block."""
    ends = column.offsets.to_numpy()
    values = column.values.slice(ends[0], ends[-1] - ends[0]).cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[there]):
        at = np.flatnonzero(there & (sizes == n))
        whole = len(at) == len(sizes) and len(values) == n * len(at)
        yield at, values.reshape(len(at), n) if whole else values[starts[at][:, None] + np.arange(n)]


def lists(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """A column array<double> of n rows from (positions, rows of one length); other rows are null, NaN is a null element as pandas has it."""
    sizes = np.full(n, -1)
    for at, block in parts:
        sizes[at] = block.shape[1]
    starts = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
    flat = np.empty(starts[-1])
    for at, block in parts:
        flat[starts[at][:, None] + np.arange(block.shape[1])] = block
    offsets = pa.array(starts.astype(np.int32), mask=np.append(sizes < 0, False))
    return pa.ListArray.from_arrays(offsets, pa.array(flat, from_pandas=True))
