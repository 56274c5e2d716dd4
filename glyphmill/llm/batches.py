"""Arrow batches in Python workers."""

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


#: What a worker keeps from one task for the next of its kind, and how it lets go of it.
KEPT: dict[str, Callable[[], None]] = {}


def trim(keep: str = "") -> None:
    """Gives back what earlier tasks of this worker freed, and what they kept for tasks of another kind than ``keep``:
    workers are used again and again, and allocators keep pages otherwise."""
    for kind, let_go in KEPT.items():
        if kind != keep:
            let_go()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20, keep: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``most`` bytes of ``column`` (one row at least), so that
    what a worker holds does not follow the number of rows in Spark's batches. ``keep``: see ``trim``."""
    trim(keep)
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        if not len(values):
            continue
        ends = np.frombuffer(values.buffers()[1], dtype=np.int32 if pa.types.is_string(values.type) or pa.types.is_binary(values.type) else np.int64)
        ends = ends[values.offset : values.offset + len(values) + 1].astype(np.int64)
        begin = 0
        while begin < len(values):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
