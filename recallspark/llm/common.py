"""Shared helpers: byte-level text blocks, ASCII words and integer ids of documents."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract here.
SPACES = " \t\n\u000b\f\r"
#: Java and DuckDB pattern of a run of them.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str, modulus: int) -> Column:
    """True where crc32 of the id as text leaves remainder 0; null ids count as the text ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus == 0


def held_out_py(doc_id: int | None, modulus: int) -> bool:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == 0


def small_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each, or a single row."""
    for rb in batches:
        if rb.num_rows == 0:
            continue
        n = pc.fill_null(pc.binary_length(rb.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n)
        start = 0
        while start < rb.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield rb.slice(start, stop - start)
            start = stop


def text_bytes(rb: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column as one uint8 array, and the rows' offsets in it; null is empty."""
    col = pc.fill_null(rb.column(column).cast(pa.large_binary()), b"")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(rb: pa.RecordBatch, column: str) -> list[str]:
    return pc.fill_null(rb.column(column), "").to_pylist()


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def _release() -> None:
    """Gives memory that a task no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that leaves its worker small: workers stay alive between tasks, beside those of other stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys (integer columns) of a partition sorted by them."""
    carry: list[pa.RecordBatch] = []
    last = None
    for rb in batches:
        n = rb.num_rows
        if not n:
            continue
        cols = [rb.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        change[0] = last is not None and first != last
        cuts = np.flatnonzero(change)
        start = 0
        for cut in cuts.tolist():
            if cut > start:
                carry.append(rb.slice(start, cut - start))
            if carry:
                yield pa.Table.from_batches(carry)
            carry, start = [], cut
        carry.append(rb.slice(start, n - start))
        last = tuple(c[-1] for c in cols)
    if carry:
        yield pa.Table.from_batches(carry)
