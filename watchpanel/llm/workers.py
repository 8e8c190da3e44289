"""What Python workers of Spark keep between tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator


def handing_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInPandas or mapInArrow, giving freed memory back to the system when a task ends.

    Workers are used again and wait beside the executor's other stages meanwhile; freed memory that the
    allocator keeps would count against the executor all that time.
    """

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library: it keeps what it likes

    return task
