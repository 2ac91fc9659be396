"""Arrow batches of bounded size for Python stages."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from kickframe.session import stage

def give_back() -> None:
    """Return freed memory to the system, for processes that live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function whose worker gives its memory back at the end of each task."""
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()
    return whole


_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Empty what other operators keep in this worker, which Spark uses again and again."""
    for other in [name for name in _held if name != owner]:
        _held.pop(other)()
        give_back()
    _held[owner] = clear


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20):
    """While frames are staged in here, at most `rows` rows of about `size` bytes go to Python at once; a row alone may be larger."""
    before = {k: spark.conf.get(k) for k in (ROWS, BYTES)}
    spark.conf.set(ROWS, str(rows))
    spark.conf.set(BYTES, str(size))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stage_arrow(df: DataFrame, name: str, rows: int = 1000) -> DataFrame:
    """`stage` for a frame with Arrow functions over texts."""
    with small_batches(df.sparkSession, rows):
        return stage(df, name)


def by_weight(weights: np.ndarray, budget: int) -> Iterator[slice]:
    """Consecutive slices whose weights sum to about `budget`; a heavier row has its own."""
    start, total = 0, 0
    for i, w in enumerate(weights.tolist()):
        if i > start and total + w > budget:
            yield slice(start, i)
            start, total = i, 0
        total += w
    if start < len(weights):
        yield slice(start, len(weights))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def utf8_lengths(column: pa.Array) -> np.ndarray:
    return np.array(pc.binary_length(column.cast(pa.binary())).fill_null(0), dtype=np.int64)
