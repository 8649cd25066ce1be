"""Reads as byte matrices: one row a read, padded on the right, with a length vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

N = ord("N")
#: Cells of one matrix; longer or more reads are handled in parts.
MAX_CELLS = 8_000_000

COMPLEMENT = np.full(256, N, np.uint8)
for _a, _b in zip(b"ACGT", b"TGCA", strict=True):
    COMPLEMENT[_a] = _b
CANONICAL = np.zeros(256, bool)
CANONICAL[list(b"ACGT")] = True


def matrix(column: pa.Array, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bytes [n, longest], lengths); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    length = np.diff(offsets)
    width = int(length.max(initial=0))
    if n and (length == width).all():
        return raw[offsets[0] : offsets[-1]].reshape(n, width), length
    out = np.full((n, width), pad, np.uint8)
    out[np.arange(width) < length[:, None]] = raw[offsets[0] : offsets[-1]]
    return out, length


def strings(m: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Row slices [start, end) as an Arrow string array."""
    n, width = m.shape
    end = np.maximum(end, start)
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    raw, base = np.ascontiguousarray(m).tobytes(), np.arange(n) * width
    data = b"".join([raw[a:b] for a, b in zip((base + start).tolist(), (base + end).tolist(), strict=True)])
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data))


def parts(lengths: list[np.ndarray], n: int) -> Iterator[slice]:
    """Slices of the rows whose matrices stay under MAX_CELLS, or of one row."""
    widest = np.maximum.reduce([np.asarray(x) for x in lengths]) if lengths else np.zeros(n, np.int64)
    at = 0
    while at < n:
        end = min(n, at + 4096)
        while end - at > 1 and (end - at) * int(widest[at:end].max(initial=0)) > MAX_CELLS:
            end = at + (end - at) // 2
        yield slice(at, end)
        at = end


def shift(m: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each row moved left by `by`, padded with 0."""
    if not by.any():
        return m
    at = np.arange(m.shape[1]) + by[:, None]
    return np.where(at < m.shape[1], np.take_along_axis(m, np.minimum(at, max(m.shape[1] - 1, 0)), 1), 0).astype(np.uint8)


def reverse_complement(m: np.ndarray, length: np.ndarray, pad: int = 0) -> np.ndarray:
    at = length[:, None] - 1 - np.arange(m.shape[1])
    return np.where(at >= 0, COMPLEMENT[np.take_along_axis(m, np.maximum(at, 0), 1)], pad).astype(np.uint8)


def text(x: str) -> np.ndarray:
    return np.frombuffer(x.encode("ascii"), np.uint8)
