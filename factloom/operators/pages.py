"""Pages of bounded size for Python steps over texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a page; a longer text is a page of its own.
PAGE_BYTES = 1 << 20


def text_pages(batches: Iterator[pa.RecordBatch], text: str, most: int = PAGE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs that hold at most ``most`` bytes of ``text`` or one row.

    What a step makes of a text can be many times its size, so rows alone do not bound its memory.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes + 64, dtype=np.int64)  # empty texts are rows as well
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
