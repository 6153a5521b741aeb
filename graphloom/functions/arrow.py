"""Helpers for functions that run on Arrow batches in Python workers."""

from __future__ import annotations

from collections.abc import Iterator


def duckdb_session():
    """A DuckDB of one thread and bounded memory that writes nothing to the machine's disk."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})


def pieces(batch, column: int, most: int = 4_000_000) -> Iterator:
    """The batch in slices of about ``most`` bytes of ``column``, whole rows each."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        # The first row that would go over ``most``; at least one row is taken.
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def gathered(batches: Iterator, column: int, most: int = 4_000_000) -> Iterator:
    """Tables of about ``most`` bytes of ``column``: small batches put together, large ones cut."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        for part in pieces(batch, column, most):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
