"""Arrow batches of long texts, a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task turns into Python's strings at once.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of the batch's rows whose texts in ``column`` have ``most`` bytes together, or one row."""
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(size), 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - size[first] + most, side="right")))
        yield batch.slice(first, last - first)
        first = last
