"""Memory of Python workers: rows in blocks of a bounded size, and what idle workers hold beside the next stage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator, Sequence

import numpy as np


def release() -> None:
    """Gives memory that nothing uses back to the system: Arrow's pool and, where there is such a call, the allocator's
    free pages. For the end of a task that held large arrays."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def blocks(sizes: Sequence[int], most: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes together are at most ``most``, or single larger ones; of ``rows`` rows at most."""
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        b = min(b, a + rows) if rows else b
        yield a, b
        a = b
