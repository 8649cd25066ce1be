"""Vectorised text primitives over Arrow string buffers.

A batch of texts is one byte buffer plus offsets; words, hashes and windows are
NumPy arrays over it, so no Python object is made per word. All separators used
here are ASCII, so splitting UTF-8 bytes never cuts a character.

Defined cases: a null text is empty; an empty text has no words and no windows; a text with fewer words
than a window is one window; very long texts are handled whole, each in a slice of its own, and words of
any length are hashed whole; no rows give empty arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; temporaries are a small multiple of eight times this.
SLICE_BYTES = 2_000_000
#: Words longer than this are hashed one by one.
LONG_WORD = 64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Digits, a-z and every byte of a non-ASCII character; for text already lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MUL = U64(0x9E3779B97F4A7C15)
_BYTE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") | 1 for b in range(256)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, or of one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


@dataclass
class Words:
    """Words in reading order: byte range in `data`, row of the batch, 64-bit hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool) -> Words:
    """Maximal runs of bytes that are `inside`, never across rows."""
    if lower:
        data = LOWER[data]
    n, rows = len(data), len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(0, U64), rows)
    is_in = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, is_in[:-1]
    start = np.flatnonzero(is_in & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, is_in[1:]
    end = np.flatnonzero(is_in & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, start, end, row, hash_ranges(data, start, end), rows)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same on every machine."""
    size = end - start
    h = size.astype(U64) * _MUL
    live = np.flatnonzero(size <= LONG_WORD)
    k = 0
    while len(live):
        live = live[size[live] > k] if k else live
        if not len(live):
            break
        h[live] = (h[live] ^ _BYTE[data[start[live] + k]]) * _MUL
        h[live] ^= h[live] >> U64(29)
        k += 1
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hash_ranges(raw, np.array([0]), np.array([len(raw)]))[0])


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of `width` words; a shorter text with words is one shingle."""
    n, counts = len(words.hash), words.counts()
    if n >= width:
        first = np.flatnonzero(words.row[: n - width + 1] == words.row[width - 1 :])
        h = np.zeros(len(first), U64)
        for j in range(width):
            h = (h + words.hash[first + j]) * U64(0xD6E8FEB86659FD93)
            h ^= h >> U64(32)
        row = words.row[first]
    else:
        row, h = np.zeros(0, np.int64), np.zeros(0, U64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        at = np.searchsorted(words.row, short)
        extra = np.zeros(len(short), U64)
        for j in range(width - 1):
            more = counts[short] > j
            extra[more] = (extra[more] + words.hash[at[more] + j]) * U64(0xD6E8FEB86659FD93)
            extra[more] ^= extra[more] >> U64(32)
        row, h = np.concatenate([row, short]), np.concatenate([h, extra])
    return row, mix(h)


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of each run of equal values."""
    if not len(ordered):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return first, np.diff(np.append(first, len(ordered)))
