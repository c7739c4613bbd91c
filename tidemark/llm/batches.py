"""Helpers for Arrow-batch functions."""

from __future__ import annotations

import ctypes
import gc
import sys
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Text bytes that an Arrow function holds as Python objects at a time.
SLICE_BYTES = 4 << 20


#: When this process has last given memory back.
_lean = [0.0]


def lean(encoders: bool = False) -> None:
    """For functions of tasks, as they start or take a batch. A worker process serves one stage after another, so what
    earlier ones remember (words of tokenizers, unless ``encoders`` says that they are in use) is forgotten, and memory
    that is free goes back to the system, at most every two seconds."""
    kept = getattr(sys.modules.get("tidemark.llm.encoding"), "_cache", None)
    if kept and not encoders:
        kept.clear()
        gc.collect()  # an encoder and its tables hold each other
    elif time.monotonic() - _lean[0] < 2:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
    _lean[0] = time.monotonic()


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterable[pa.RecordBatch], column: int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``max_bytes`` of one string column (or one row, if it is larger)."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(b.column(column)).cast(pa.int64()), 0)).to_numpy()
        start = 0
        while start < b.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(ends.searchsorted(base + max_bytes, "right")))
            yield b.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """A string column with nulls as empty texts."""
    return [x or "" for x in batch.column(column).to_pylist()]
