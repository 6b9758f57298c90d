"""Arrow batches of texts for mapInArrow functions: some megabytes at a time, results as record batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a function gets at once; one longer text comes alone.
SLICE = 2 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have up to limit bytes together."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    size = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
    upto = np.cumsum(size)
    start = 0
    while start < len(texts):
        base = upto[start - 1] if start else 0.0
        stop = max(start + 1, int(np.searchsorted(upto, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(df: DataFrame, column: str, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], limit: int = SLICE) -> DataFrame:
    """work on slices of df of up to limit bytes of text; it returns a record batch with the columns of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                yield work(part)

    return df.mapInArrow(run, schema)


def arrays(flat: np.ndarray, count: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column from its values one after another and the length of each list."""
    offsets = np.zeros(len(count) + 1, np.int32)
    np.cumsum(count, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def spare(name: str, *tables: DataFrame) -> str:
    """A column name that starts like name and that no table has, without regard to case."""
    taken = {c.lower() for t in tables for c in t.columns}
    out = f"_{name}"
    while out.lower() in taken:
        out = f"_{out}"
    return out


def text_of(name: str = "text"):
    """A text column in which null is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
