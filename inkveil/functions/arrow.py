"""Arrow batches in slices of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice.
SLICE_BYTES = 1 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices of at most so many bytes of a column of texts, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        number, start = np.cumsum(sizes, dtype=np.int64) // most, 0
        for stop in [*(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]:
            if stop > start:
                yield batch.slice(start, stop - start)
            start = stop
