"""Texts of Arrow batches in blocks of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_blocks(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of rows of about ``size`` bytes of text or one row; only one run at a time becomes Python strings."""
    for start, texts in text_slices(batch, column, size):
        yield start, texts.to_pylist()


def text_slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, pa.StringArray]]:
    """The same runs, left in Arrow."""
    texts = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + size, "right")), start + 1)
        yield start, texts.slice(start, stop - start)
        start = stop
