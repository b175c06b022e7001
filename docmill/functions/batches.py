"""What Python steps over Arrow batches share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 256


def slices(batches, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what a step holds as Python objects is bounded; freed memory is given back at the end."""
    try:
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                yield b.slice(lo, rows)
    finally:
        pa.default_memory_pool().release_unused()
