"""Arrow batches in small parts, so that what a worker makes of one is small too."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

BYTES = 1 << 20  # of a part, by the batch's mean row


def small(batches: Iterable[pa.RecordBatch], size: int = BYTES) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, size * b.num_rows // max(b.nbytes, 1))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
