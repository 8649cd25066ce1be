"""Splitting reads at internal delimiters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from readloom.kernels.match import MatchParams, all_matches


@dataclass(frozen=True)
class SegmentParams:
    min_length: int = 1
    max_fragments: int = 64
    terminal: str = "keep"  # or discard: what stands before the first or behind the last delimiter


@dataclass
class Fragments:
    """Emitted fragments in order of read and place, and counts a read."""

    row: np.ndarray
    index: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray  # delimiter number or -1
    right: np.ndarray
    candidates: np.ndarray
    delimiters: np.ndarray
    empty: np.ndarray
    terminal: np.ndarray
    short: np.ndarray
    over_limit: np.ndarray
    hits: np.ndarray  # [reads, delimiter patterns]


def select(row, start, errors, overlap, consumed, which) -> np.ndarray:
    """Indices of the delimiters kept: by start, errors, error rate, longest overlap, first declared; from the left,
    each that begins before the last kept one ends is passed over."""
    rate = (errors / np.maximum(overlap, 1) * 1e9).astype(np.int64)
    order = np.lexsort((which, -overlap, rate, errors, start, row))
    kept, last_row, end = [], -1, 0
    for i, r, s, c in zip(order.tolist(), row[order].tolist(), start[order].tolist(), consumed[order].tolist(), strict=True):
        if r != last_row:
            last_row, end = r, 0
        if s >= end:
            kept.append(i)
            end = s + c
    return np.array(kept, np.int64)


def segment(m: np.ndarray, length: np.ndarray, delimiters: list[str], match: MatchParams, p: SegmentParams) -> Fragments:
    """Pieces between delimiters, dropped if empty, terminal (where discarded), too short or over the limit, in that order."""
    n = len(length)
    hits = all_matches(m, length, delimiters, match)
    kept = select(*hits)
    row, start, _, _, consumed, which = (x[kept] for x in hits)
    count = np.bincount(row, minlength=n)
    # the cuts of a read: its start, each delimiter, its end
    at = np.repeat(np.arange(n), count + 1)
    first = np.cumsum(count + 1) - (count + 1)
    nth = np.arange(len(at)) - first[at]
    before = np.cumsum(count) - count
    left_i, right_i = before[at] + nth - 1, before[at] + nth
    has_left, has_right = nth > 0, nth < count[at]
    pick = lambda x, i, has, other: np.where(has, x[np.clip(i, 0, max(len(x) - 1, 0))] if len(x) else 0, other)
    begin = pick(start + consumed, left_i, has_left, 0)
    end = pick(start, right_i, has_right, length[at])
    left, right = pick(which, left_i, has_left, -1), pick(which, right_i, has_right, -1)
    size = end - begin
    empty = size <= 0
    terminal = ~empty & (p.terminal == "discard") & (~has_left | ~has_right)
    short = ~empty & ~terminal & (size < p.min_length)
    good = ~(empty | terminal | short)
    place = np.cumsum(good) - good
    offset = place[first] if len(at) else place
    index = place - offset[at]
    over = good & (index >= p.max_fragments)
    out = good & ~over
    by_read = lambda x: np.bincount(at[x], minlength=n)
    seen = np.zeros((n, len(delimiters)), np.int64)
    np.add.at(seen, (row, which), 1)
    return Fragments(at[out], index[out], begin[out], end[out], left[out], right[out], np.bincount(hits[0], minlength=n), count, by_read(empty), by_read(terminal), by_read(short), by_read(over), seen)
