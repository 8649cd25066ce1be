"""Paired reads: the overlap of mates, and base correction within it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from readloom.kernels.bytes import CANONICAL, COMPLEMENT, N, reverse_complement

_NEVER = 2  # stands for N in R1: equals no base
_PAD1, _PAD2 = 0, 1


@dataclass(frozen=True)
class OverlapParams:
    min_overlap: int = 30
    max_error_rate: float = 0.10


@dataclass
class Overlap:
    """found, offset of R2's reverse complement on R1, length and mismatches; insert = offset + R2's length."""

    found: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    mismatches: np.ndarray
    insert: np.ndarray


def overlap(m1: np.ndarray, len1: np.ndarray, m2: np.ndarray, len2: np.ndarray, params: OverlapParams) -> Overlap:
    """The overlap of each pair: longest, then fewest mismatches, then smallest offset."""
    n = len(len1)
    a = np.where(np.arange(m1.shape[1]) < len1[:, None], m1, _PAD1).astype(np.uint8)
    a[a == N] = _NEVER
    b = reverse_complement(m2, len2, _PAD2)
    best_o, best_n, best_e = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    width1, width2 = a.shape[1], b.shape[1]
    limits = np.floor(np.arange(min(width1, width2) + 1) * params.max_error_rate).astype(np.int64)
    for o in range(params.min_overlap - width2, width1 - params.min_overlap + 1):
        lo, hi = max(o, 0), min(width1, o + width2)
        size = np.minimum(len1, o + len2) - lo
        possible = np.flatnonzero((size >= params.min_overlap) & (size >= best_n))
        if not len(possible):
            continue
        x, y = (a[:, lo:hi], b[:, lo - o : hi - o]) if len(possible) == n else (a[possible, lo:hi], b[possible, lo - o : hi - o])
        own = size[possible]
        e = np.count_nonzero(x != y, axis=1) - (hi - lo - own)
        better = (e <= limits[own]) & ((own > best_n[possible]) | (e < best_e[possible]))
        at = possible[better]
        best_o[at], best_n[at], best_e[at] = o, own[better], e[better]
    found = best_n > 0
    return Overlap(found, best_o, best_n, best_e, np.where(found, best_o + len2, 0))


@dataclass(frozen=True)
class CorrectionParams:
    donor: int = 30
    recipient: int = 14


@dataclass
class Edits:
    """Edits in order of read, mate and place: one entry an edited base; and counts a read."""

    row: np.ndarray
    mate: np.ndarray  # that is edited, 1 or 2
    position: np.ndarray
    donor_position: np.ndarray
    original: np.ndarray
    corrected: np.ndarray
    original_quality: np.ndarray
    corrected_quality: np.ndarray
    corrected_r1: np.ndarray
    corrected_r2: np.ndarray
    unresolved: np.ndarray
    noncanonical: np.ndarray


def correct(m1, q1, len1, m2, q2, len2, over: Overlap, params: CorrectionParams) -> Edits:
    """Where mates disagree inside the overlap, a confident base replaces a doubtful one, quality byte and all."""
    n = len(len1)
    t = np.arange(int(over.length.max(initial=0)))
    live = over.found[:, None] & (t < over.length[:, None])
    p1 = np.maximum(over.offset, 0)[:, None] + t
    p2 = len2[:, None] - 1 - np.maximum(-over.offset, 0)[:, None] - t
    take = lambda m, p: np.take_along_axis(m, np.clip(p, 0, max(m.shape[1] - 1, 0)), 1) if m.shape[1] else np.zeros_like(p, np.uint8)
    b1, b2 = take(m1, p1), take(m2, p2)
    x1, x2 = take(q1, p1).astype(int) - 33, take(q2, p2).astype(int) - 33
    differ = live & ((b1 != COMPLEMENT[b2]) | (b1 == N))
    from1 = differ & (x1 >= params.donor) & (x2 <= params.recipient)
    from2 = differ & (x2 >= params.donor) & (x1 <= params.recipient)
    good1, good2 = from1 & CANONICAL[b1], from2 & CANONICAL[b2]
    skipped = (from1 & ~good1) | (from2 & ~good2)
    unresolved = differ & ~from1 & ~from2
    row1, c1 = np.nonzero(good2)  # R1 edited
    row2, c2 = np.nonzero(good1)
    row, mate = np.concatenate([row1, row2]), np.repeat([1, 2], [len(row1), len(row2)])
    pos = np.concatenate([p1[row1, c1], p2[row2, c2]])
    fields = [row, mate, pos, np.concatenate([p2[row1, c1], p1[row2, c2]]), np.concatenate([b1[row1, c1], b2[row2, c2]]), COMPLEMENT[np.concatenate([b2[row1, c1], b1[row2, c2]])], np.concatenate([x1[row1, c1], x2[row2, c2]]), np.concatenate([x2[row1, c1], x1[row2, c2]])]
    order = np.lexsort((pos, mate, row))
    fields = [f[order] for f in fields]
    return Edits(*fields, good2.sum(1), good1.sum(1), unresolved.sum(1), skipped.sum(1)) if n else Edits(*fields, *(np.zeros(0, np.int64) for _ in range(4)))


def apply(m1, q1, m2, q2, edits: Edits) -> tuple[np.ndarray, ...]:
    """Copies of the four matrices with the edits made."""
    out = [x.copy() for x in (m1, q1, m2, q2)]
    for mate in (1, 2):
        at = edits.mate == mate
        out[2 * mate - 2][edits.row[at], edits.position[at]] = edits.corrected[at]
        out[2 * mate - 1][edits.row[at], edits.position[at]] = edits.corrected_quality[at] + 33
    return tuple(out)
