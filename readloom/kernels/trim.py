"""Trims, as updates of half-open spans [s, e), in a fixed order; bases removed by each are counted."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from readloom.kernels.bytes import N

OPS = ("fixed", "quality", "terminal_n", "poly_g", "poly_x", "max_length")


@dataclass(frozen=True)
class TrimParams:
    front: int = 0
    tail: int = 0
    quality_front: int | None = None
    quality_right: int | None = None
    quality_tail: int | None = None
    window: int = 4
    terminal_n: bool = False
    poly_g: bool = False
    poly_x: bool = False
    poly_min: int = 10
    poly_rate: float = 0.10
    max_length: int | None = None

    @property
    def needs_quality(self) -> bool:
        return (self.quality_front, self.quality_right, self.quality_tail) != (None, None, None)

    @property
    def enabled(self) -> tuple[str, ...]:
        """Names of the trims that are on."""
        on = {"fixed": self.front > 0 or self.tail > 0, "quality": self.needs_quality, "terminal_n": self.terminal_n, "poly_g": self.poly_g, "poly_x": self.poly_x, "max_length": self.max_length is not None}
        return tuple(op for op in OPS if on[op])


def _sums(phred: np.ndarray) -> np.ndarray:
    out = np.zeros((phred.shape[0], phred.shape[1] + 1), np.int32)
    np.cumsum(phred, axis=1, out=out[:, 1:], dtype=np.int32)
    return out


def quality_front(sums: np.ndarray, s: np.ndarray, e: np.ndarray, q: int, window: int) -> np.ndarray:
    """The first window, cut by the end, whose mean reaches q; the end if none does."""
    at = np.arange(sums.shape[1])
    stop = np.minimum(at + window, e[:, None])
    ok = (at >= s[:, None]) & (at < e[:, None]) & (np.take_along_axis(sums, np.maximum(stop, 0), 1) - sums >= q * (stop - at))
    return np.where(ok.any(1), ok.argmax(1), e)


def quality_tail(phred: np.ndarray, s: np.ndarray, e: np.ndarray, q: int, window: int) -> np.ndarray:
    """The last end whose window, cut by the start, reaches q; the start if none does. Ends are tried from the last on, for
    the reads that still want one."""
    n, width = phred.shape
    sums = np.zeros((width + 1, n), np.int32)
    for at, column in enumerate(np.ascontiguousarray(phred.T)):  # rows of one piece of memory
        np.add(sums[at], column, out=sums[at + 1])
    out, live = s.copy(), np.flatnonzero(e > s)
    if not len(live):
        return out
    for at in range(int(e.max()), int(s[live].min()), -1):
        begin = np.maximum(at - window, s[live])
        here = sums[at, live] - sums[begin, live] >= q * (at - begin)
        here &= (at <= e[live]) & (at > s[live])
        out[live[here]] = at
        live = live[~here]
        if not len(live):
            break
    return out


def quality_right(sums: np.ndarray, s: np.ndarray, e: np.ndarray, q: int, window: int) -> np.ndarray:
    """Cut at the first whole window below q; a window is at most the span."""
    w = np.minimum(window, e - s)[:, None]
    at = np.arange(sums.shape[1])
    stop = np.minimum(at + w, sums.shape[1] - 1)
    bad = (at >= s[:, None]) & (at + w <= e[:, None]) & (w > 0) & (np.take_along_axis(sums, stop, 1) - sums < q * w)
    return np.where(bad.any(1), bad.argmax(1), e)


def terminal_n(m: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(m.shape[1])
    other = (m != N) & (at >= s[:, None]) & (at < e[:, None])
    has = other.any(1)
    first = np.where(has, other.argmax(1), e)
    last = np.where(has, m.shape[1] - other[:, ::-1].argmax(1), e)
    return first, last


def poly_tail(m: np.ndarray, s: np.ndarray, e: np.ndarray, base: int, least: int, rate: float) -> np.ndarray:
    """Length of the longest suffix of at least `least` bases with mismatches <= length * rate; 0 if none."""
    miss = np.zeros((m.shape[0], m.shape[1] + 1), np.int64)
    np.cumsum(m != base, axis=1, out=miss[:, 1:])
    at = np.arange(m.shape[1] + 1)
    size = e[:, None] - at
    ok = (at >= s[:, None]) & (size >= least) & (np.take_along_axis(miss, e[:, None], 1) - miss <= size * rate)
    return np.where(ok.any(1), e - ok.argmax(1), 0)


def trim(m: np.ndarray, quality: np.ndarray | None, s: np.ndarray, e: np.ndarray, p: TrimParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bases removed by each of OPS [n, 6])."""
    removed = np.zeros((len(s), len(OPS)), np.int64)

    def count(op: str, s2: np.ndarray, e2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        removed[:, OPS.index(op)] += (e - s) - (e2 - s2)
        return s2, e2

    s2 = np.minimum(s + p.front, e)
    s, e = count("fixed", s2, np.maximum(e - p.tail, s2))
    if p.needs_quality:
        phred = np.maximum(quality, 33) - np.uint8(33)
        sums = _sums(phred) if (p.quality_front, p.quality_right) != (None, None) else None
        if p.quality_front is not None:
            s, e = count("quality", quality_front(sums, s, e, p.quality_front, p.window), e)
        if p.quality_right is not None:
            s, e = count("quality", s, quality_right(sums, s, e, p.quality_right, p.window))
        if p.quality_tail is not None:
            s, e = count("quality", s, quality_tail(phred, s, e, p.quality_tail, p.window))
    if p.terminal_n:
        s, e = count("terminal_n", *terminal_n(m, s, e))
    if p.poly_g:
        s, e = count("poly_g", s, e - poly_tail(m, s, e, ord("G"), p.poly_min, p.poly_rate))
    if p.poly_x:
        longest = np.maximum.reduce([poly_tail(m, s, e, b, p.poly_min, p.poly_rate) for b in b"ACGT"])
        s, e = count("poly_x", s, e - longest)
    if p.max_length is not None:
        s, e = count("max_length", s, np.minimum(e, s + p.max_length))
    return s, e, removed


@dataclass(frozen=True)
class FilterParams:
    min_length: int | None = None
    length_limit: int | None = None
    max_n: int | None = None
    max_n_fraction: float | None = None
    qualified_quality: int = 15
    max_unqualified_bases: int | None = None
    max_unqualified_fraction: float | None = None
    min_mean_quality: int | None = None
    min_complexity: float | None = None

    @property
    def active(self) -> bool:
        return any(v is not None for k, v in vars(self).items() if k != "qualified_quality")

    @property
    def needs_quality(self) -> bool:
        return (self.max_unqualified_bases, self.max_unqualified_fraction, self.min_mean_quality) != (None, None, None)


REASONS = ("TOO_SHORT", "TOO_LONG", "TOO_MANY_N", "TOO_MANY_LOW_QUAL", "LOW_MEAN_QUAL", "LOW_COMPLEXITY", "LINKED_UNMATCHED")


def reasons(m: np.ndarray, quality: np.ndarray | None, s: np.ndarray, e: np.ndarray, p: FilterParams) -> np.ndarray:
    """Bit set of every rule that the span fails, in the order of REASONS."""
    n = e - s
    at = np.arange(m.shape[1])
    by_base = p.needs_quality or any(x is not None for x in (p.max_n, p.max_n_fraction, p.min_complexity))
    inside = (at >= s[:, None]) & (at < e[:, None]) if by_base else None
    out = np.zeros(len(s), np.int64)

    def add(bit: int, fails: np.ndarray) -> None:
        out[fails] |= 1 << bit

    fraction = lambda count: count / np.maximum(n, 1)
    if p.min_length is not None:
        add(0, n < p.min_length)
    if p.length_limit is not None:
        add(1, n > p.length_limit)
    if p.max_n is not None or p.max_n_fraction is not None:
        ns = ((m == N) & inside).sum(1)
        if p.max_n is not None:
            add(2, ns > p.max_n)
        if p.max_n_fraction is not None:
            add(2, (n > 0) & (fraction(ns) > p.max_n_fraction))
    if p.needs_quality:
        phred = np.maximum(quality.astype(np.int64) - 33, 0)
        low = ((phred < p.qualified_quality) & inside).sum(1)
        if p.max_unqualified_bases is not None:
            add(3, low > p.max_unqualified_bases)
        if p.max_unqualified_fraction is not None:
            add(3, (n > 0) & (fraction(low) > p.max_unqualified_fraction))
        if p.min_mean_quality is not None:
            add(4, (phred * inside).sum(1) < p.min_mean_quality * n)
    if p.min_complexity is not None:
        changes = ((m[:, 1:] != m[:, :-1]) & inside[:, 1:] & inside[:, :-1]).sum(1)
        add(5, np.where(n > 1, changes / np.maximum(n - 1, 1), 0.0) < p.min_complexity)
    return out
