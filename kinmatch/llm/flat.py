"""Texts of an Arrow batch as one flat byte buffer, so that numpy handles many texts at once."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A slice of a batch holds about so many bytes of text, or one row. Bounds the memory of a task.
SLICE_BYTES = 2 << 20

U = np.uint64
_P, _P_INV = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker; task functions travel by value and have no lasting globals."""
    return sys.modules.setdefault("_kinmatch_worker", types.ModuleType("_kinmatch_worker")).__dict__


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good diffusion."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and len + 1 offsets; a null text is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        offsets = np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece hold about `limit` bytes, or are one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = flat_text(batch.column(text))
        start = 0
        while start < n:
            end = max(int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1, start + 1)
            end = n if end > n else end
            yield batch.slice(start, end - start)
            start = end


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes that `apart`, white space, lacks), and each text's first word, len + 1."""
    inside = ~apart[data]
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by differences of polynomial prefix sums."""
    n = len(data)
    powers = np.full(n + 1, _P, U)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers[:n], out=sums[1:])
    back = np.full(n + 1, _P_INV, U)
    back[0] = 1
    np.cumprod(back, out=back)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U) * U(0xD1342543DE82EF95))
