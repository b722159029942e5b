"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as Java and DuckDB patterns spell the complement.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def fold(column: str, folds: int) -> Column:
    """crc32 of an id as text modulo the number of folds; a null id belongs to no fold (-1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(-1))


def fresh(*names: str, prefix: str = "llm") -> dict[str, str]:
    """Column names that cannot clash with those of a caller's table."""
    token = uuid.uuid4().hex[:8]
    return {name: f"_{prefix}_{name}_{token}" for name in names}


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def blocks(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts (from, to) of about ``size`` bytes together; a longer text is a run of its own."""
    start = total = 0
    for i, raw in enumerate(texts):
        if total and total + len(raw) > size:
            yield start, i
            start, total = i, 0
        total += len(raw)
    if start < len(texts):
        yield start, len(texts)


def spans(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The same from the sizes of the texts."""
    ends, out, at = np.cumsum(sizes, dtype=np.int64), [], 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, side="right")))
        out.append((at, to))
        at = to
    return out


def give_back() -> None:
    """Returns memory that the worker has freed but still holds to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(work: Callable) -> Callable:
    """``work`` over a task's batches, after which the worker, which outlives the stage, gives back what the task took."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run
