"""Small helpers that the operators of this package share."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Task code travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that a task turns into numpy arrays at a time.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)


def by_value(module_name: str) -> None:
    """Let the functions of a module of this package travel with the job."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def worker_cache(owner: str) -> dict:
    """A dict that lives in the Python worker over the tasks of one operator; another operator's task drops it."""
    held = sys.__dict__.setdefault("_loomwork_worker_cache", {})
    if held.get("owner") != owner:
        held.clear()
        held["owner"] = owner
        pa.default_memory_pool().release_unused()
    return held


#: Most bytes of an Arrow batch; Spark's own bound is 64 MB, of which a task holds several copies.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches hold at most BATCH_BYTES, whatever the size of their rows, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept in the worker up to a few MB."""
    cache = sys.__dict__.setdefault("_loomwork_powers", {})
    have = cache.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        filled = 1
        while filled < size:  # doubling: base**(k+i) = base**k * base**i
            more = min(filled, size - filled)
            have[filled : filled + more] = have[:more] * np.uint64(pow(base, filled, 1 << 64))
            filled += more
        if size <= 4 * CHUNK_BYTES:
            cache[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * base**position; n+1 values."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end), independent of where they stand."""
    back = _powers(_P_INV, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes.

    Yields (first row, row after the last, bytes, n+1 offsets into them); null is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        last = min(n, max(row + 1, last))
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space), and n+1 bounds by row."""
    inside = ~_SPACE[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        firsts = bounds[:-1]
        before[firsts[firsts < len(data)]] = False
        lasts = bounds[1:] - 1
        after[lasts[lasts >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def symbol_table(fold_case: bool) -> np.ndarray:
    """Byte -> one of 64 symbols: a-z, capitals (or folded into a-z), digits, space, newline, other control, 32 signs, other bytes."""
    table = np.full(256, 63, dtype=np.int64)
    table[:32] = 30
    table[[10, 127]] = 29, 30
    table[32] = 28
    table[48:58] = 27
    table[97:123] = np.arange(26)
    table[65:91] = np.arange(26) if fold_case else 26
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    table[signs] = 31 + np.arange(len(signs))
    return table
