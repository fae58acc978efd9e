"""Whole groups of rows from partitions that are sorted by the group's key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of one group or more, and where each group starts (one more for the end)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= least_rows:
            rows, starts = _grouped(held, keys)
            if len(starts) > 2:
                yield rows.slice(0, starts[-2]), starts[:-1]
                held = rows.slice(starts[-2]).to_batches()
    if held:
        yield _grouped(held, keys)


def _grouped(held: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    rows = pa.Table.from_batches(held).combine_chunks()
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for key in keys:
        value = rows.column(key).combine_chunks().to_numpy(zero_copy_only=False)
        new[1:] |= value[1:] != value[:-1]
    return rows, np.append(np.flatnonzero(new), rows.num_rows)
