"""What a Python worker keeps between tasks.

Spark reuses Python workers, for other operators of the session as well, and
memory that a task has freed stays with its process. Tasks here return that
memory when they end, and drop what another operator's tasks have held.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_held: dict[Any, Any] = {}


def hold(key: Any, make: Callable[[], Any]) -> Any:
    """make()'s result, kept for the tasks to come that hold things."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drops all that is held."""
    _held.clear()


def give_back() -> None:
    """Returns freed memory to the operating system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's batches by BATCH_BYTES, or by a single longer row, where it sets no bound itself.

    Spark's own bounds, 10,000 rows and 64 MB, let a batch of texts take several
    hundred MB in a worker and its executor, as results are built beside it.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def task(function: Callable[[Iterator], Iterator], holds: bool = False) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow or mapInPandas that leaves its worker small; holds: it uses what hold() has kept."""

    def run(batches: Iterator) -> Iterator:
        if not holds:
            let_go()
        try:
            yield from function(batches)
        finally:
            give_back()

    return run
