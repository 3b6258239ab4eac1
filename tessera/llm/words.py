"""Vectorised splitting and hashing of words over the bytes of an Arrow string column.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is ``[^\\x20\\x09-\\x0D]+`` in UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of one Arrow batch between the JVM and Python, unless the session sets its own bound.
BATCH_BYTES = "2m"
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def bound_batches() -> None:
    """Bounds Arrow batches of the active session by bytes. Left alone, a batch has 10,000 rows however long
    their texts, and both sides hold several such batches for each task."""
    conf = SparkSession.active().conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return table


def byte_values(fold_case: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``fold_case`` A-Z take those of a-z."""
    table = np.random.default_rng(20240229).integers(1, 1 << 64, 256, np.uint64)
    if fold_case:
        table[0x41:0x5B] = table[0x61:0x7B]
    return table


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, limit: int = CHUNK):
    """Yields (first row, row after the last, bytes, offsets) of about ``limit`` bytes, whole rows."""
    data, offsets = string_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def split(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions where words start and end, and for each row the index of its first word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = space[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = True
    word = ~gap
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, from prefix sums modulo 2^64."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(_BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def hash_runs(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive words, across row ends too; callers cut those off."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        total, odd = np.zeros(n, np.uint64), 1
        for i in range(k):
            odd = (odd * 0x9FB21C651E98DF25 + 2 * k) % (1 << 64)
            total += words[i : i + n] * np.uint64(odd)
        return mix(total)
    return hash_spans(words, np.arange(n), np.arange(k, k + n))


def hash_spans(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words from each ``begin`` up to ``end``, from prefix sums modulo 2^64."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_BASE, len(words)), out=sums[1:])
    h = (sums[end] - sums[begin]) * powers(_BASE_INVERSE, len(words) + 1)[begin]
    return mix(h + (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
