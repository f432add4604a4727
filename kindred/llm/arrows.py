"""Sorted Arrow batches cut into whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the groups of a table that is sorted by keys (not null)."""
    new = np.zeros(max(len(table) - 1, 0), bool)
    for k in keys:
        new |= _differs(table[k].combine_chunks())
    return np.concatenate([[0], np.flatnonzero(new) + 1]) if len(table) else np.zeros(0, np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, starts) with complete groups only; holds one batch and the group it ends in."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        end = tuple(batch.column(batch.schema.get_field_index(k))[-1].as_py() for k in keys)
        begin = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
        if held and begin == end == last:
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch])
        at = starts(table, keys)
        if at[-1]:
            yield table.slice(0, at[-1]), at[:-1]
        held, last = table.slice(at[-1]).combine_chunks().to_batches(), end
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts(table, keys)
