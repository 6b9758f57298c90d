"""Arrow batches cut by what their texts hold, not by rows alone, so that a worker's memory doesn't depend on their number."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a text column, or items of a list column, that a function has at once; one longer value comes alone.
SLICE = 1 << 18


def in_slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose last column, strings or lists, holds up to limit bytes or items together."""
    for b in batches:
        column = b.column(b.num_columns - 1)
        length = pc.list_value_length(column) if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length(column)
        upto = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(upto):
            base = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, base + limit, side="right")))
            yield b.slice(start, stop - start)
            start = stop
