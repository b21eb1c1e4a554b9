"""Arrow batches in pieces of bounded size, for functions that make Python objects of their rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows with about so many bytes of text are turned into Python objects at a time, which bounds a worker's memory.
SLICE_BYTES = 2 << 20


def slices(batches: Iterable[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, in slices with about ``size`` bytes in ``column``; a longer value has a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
            yield batch.slice(a, b - a)
            a = b
