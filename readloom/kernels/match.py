"""Matches of short patterns against reads: 3' adapters by substitutions or edits, 5' flanks, linked flanks, catalogues.

All functions take a byte matrix (padded with 0) and lengths and return one value a read;
start -1 means no match. Ties are decided by the keys that each docstring lists, in order.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

from readloom.kernels.bytes import N, shift, text


@dataclass(frozen=True)
class MatchParams:
    min_overlap: int = 8
    max_error_rate: float = 0.10
    max_errors: int | None = None
    allow_indels: bool = False

    def limit(self, overlap: np.ndarray | int) -> np.ndarray:
        """Errors allowed at an overlap: the double product, truncated, and the cap."""
        out = np.floor(np.asarray(overlap, np.float64) * self.max_error_rate).astype(np.int64)
        return out if self.max_errors is None else np.minimum(out, self.max_errors)


@dataclass
class Hits:
    """start, errors, overlap (pattern bases), consumed (read bases), pattern; one a read."""

    start: np.ndarray
    errors: np.ndarray
    overlap: np.ndarray
    consumed: np.ndarray
    which: np.ndarray

    @classmethod
    def none(cls, n: int) -> Hits:
        return cls(*(np.full(n, v, np.int64) for v in (-1, 0, 0, 0, -1)))

    def put(self, rows: np.ndarray, *values: np.ndarray | int) -> None:
        for field, v in zip((self.start, self.errors, self.overlap, self.consumed, self.which), values, strict=True):
            field[rows] = v


def pattern(sequence: str) -> np.ndarray:
    """Bytes that a read must equal; N equals nothing."""
    out = text(sequence).copy()
    out[out == N] = 255
    return out


def errors_at(m: np.ndarray, length: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(errors, overlap) of the pattern laid at every place of every read, [n, width]."""
    n, width = m.shape
    wide = np.zeros((n, width + len(a)), np.uint8)
    wide[:, :width] = m
    errors = np.zeros((n, width), np.uint8 if len(a) < 256 else np.int32)
    differs = np.empty((n, width), bool)
    for j, base in enumerate(a):
        np.not_equal(wide[:, j : j + width], base, out=differs)
        errors += differs.view(np.uint8)
    overlap = np.clip(length[:, None].astype(np.int32) - np.arange(width, dtype=np.int32), 0, len(a))
    return errors - (len(a) - overlap), overlap


def accepted(m: np.ndarray, length: np.ndarray, a: np.ndarray, params: MatchParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    errors, overlap = errors_at(m, length, a)
    ok = (overlap >= params.min_overlap) & (errors <= params.limit(np.arange(len(a) + 1))[overlap])
    return ok, errors, overlap


def first_accepted(columns: np.ndarray, length: np.ndarray, a: np.ndarray, params: MatchParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(read, start, errors, overlap) of each read's first accepted place. `columns` is the matrix with a row a place and
    len(a) empty ones more, so that each comparison runs over one piece of memory."""
    width, n = columns.shape[0] - len(a), columns.shape[1]
    errors = np.zeros((width, n), np.uint8 if len(a) < 255 else np.int32)
    differs = np.empty((width, n), bool)
    for j, base in enumerate(a):
        np.not_equal(columns[j : j + width], base, out=differs)
        errors += differs.view(np.uint8)
    # places beyond the end of a read count as errors: what is allowed at each overlap, and one more
    o = np.arange(len(a) + 1)
    allowed = np.where(o >= params.min_overlap, params.limit(o) + len(a) - o + 1, 0).astype(errors.dtype)
    place = np.arange(width)[:, None]
    if n and (length == length[0]).all():
        ok = errors < allowed[np.clip(length[0] - place, 0, len(a))]
    else:
        ok = errors < allowed[np.clip(length.astype(np.int32) - place.astype(np.int32), 0, len(a))]
    read = np.flatnonzero(ok.any(0))
    start = ok[:, read].argmax(0) if width else read
    overlap = np.minimum(length[read] - start, len(a))
    return read, start, errors[start, read].astype(np.int64) - (len(a) - overlap), overlap


def three_prime(m: np.ndarray, length: np.ndarray, patterns: list[str], params: MatchParams) -> Hits:
    """The winning 3' match: smallest start, fewest errors, longest overlap, first declared."""
    if params.allow_indels:
        return three_prime_indels(m, length, patterns, params)
    n = len(length)
    if len(patterns) >= INDEXED and (index := seed_index(tuple(patterns), params)):
        return index.search(m, length)
    out = Hits.none(n)
    longest = max(map(len, patterns), default=0)
    columns = np.zeros((m.shape[1] + longest, n), np.uint8)
    columns[: m.shape[1]] = m.T
    for k, sequence in enumerate(patterns):
        row, p, e, o = first_accepted(columns[: m.shape[1] + len(sequence)], length, pattern(sequence), params)
        was, errors, overlap = out.start[row], out.errors[row], out.overlap[row]
        better = (was < 0) | (p < was) | (p == was) & ((e < errors) | (e == errors) & (o > overlap))
        out.put(row[better], p[better], e[better], o[better], o[better], k)
    return out


def block_size(pattern_length: int, params: MatchParams) -> int:
    """The longest block such that any accepted prefix has more whole blocks than errors; 0 if none."""
    i = np.arange(params.min_overlap, pattern_length + 1)
    for b in range(8, 1, -1):
        if (i // b > params.limit(i)).all():
            return b
    return 0


#: From so many patterns on, starts are proposed by an index of their blocks.
INDEXED = 6
#: Proposed starts that are compared at once.
PROPOSALS = 400_000
_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = range(4)


@dataclass(frozen=True)
class SeedIndex:
    """Blocks of patterns by their code: any accepted match has a block without error at its place, so every match is
    proposed by the code of some place of the read. Blocks with other letters than ACGT equal nothing and need no entry."""

    block: int
    begins: np.ndarray  # of each code's entries
    which: np.ndarray
    offset: np.ndarray
    patterns: np.ndarray  # [patterns, longest], padded with 255
    size: np.ndarray
    params: MatchParams

    def search(self, m: np.ndarray, length: np.ndarray) -> Hits:
        """What three_prime() gives for all patterns."""
        out = Hits.none(len(length))
        width, b = m.shape[1], self.block
        if width < b:
            return out
        codes = np.zeros((len(m), width - b + 1), np.int32)
        bad = np.zeros(codes.shape, bool)
        base = _CODE[m]
        for j in range(b):
            part = base[:, j : j + codes.shape[1]]
            codes = codes << 2 | (part & 3)
            bad |= part == 4
        bad |= np.arange(codes.shape[1]) + b > length[:, None]
        n = np.where(bad, 0, np.diff(self.begins)[codes])
        ends = np.cumsum(n.sum(1))
        at = 0
        while at < len(m):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + PROPOSALS, side="right")))
            self._best(out, m, length, codes, n, at, end)
            at = end
        return out

    def _best(self, out: Hits, m: np.ndarray, length: np.ndarray, codes: np.ndarray, n: np.ndarray, at: int, end: int) -> None:
        row, place = np.nonzero(n[at:end])
        row += at
        times = n[row, place]
        entry = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.begins[codes[row, place]], times)
        row, place = np.repeat(row, times), np.repeat(place, times)
        which, start = self.which[entry], place - self.offset[entry]
        overlap = np.minimum(self.size[which], length[row] - start)
        fits = (start >= 0) & (overlap >= self.params.min_overlap)
        row, start, which, overlap = (x[fits] for x in (row, start, which, overlap))
        limit = self.params.limit(overlap)
        errors = np.zeros(len(row), np.int32)
        live = np.arange(len(row))
        for j in range(self.patterns.shape[1]):
            live = live[(overlap[live] > j) & (errors[live] <= limit[live])]
            if not len(live):
                break
            errors[live] += m[row[live], start[live] + j] != self.patterns[which[live], j]
        ok = errors <= limit
        row, start, errors, overlap, which = (x[ok] for x in (row, start, errors, overlap, which))
        order = np.lexsort((which, -overlap, errors, start, row))
        first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(order) else order
        out.put(row[first], start[first], errors[first], overlap[first], overlap[first], which[first])


@functools.lru_cache(maxsize=16)
def seed_index(patterns: tuple[str, ...], params: MatchParams) -> SeedIndex | None:
    """An index of `patterns`, or none where the error rate leaves no block of four bases free of errors for sure."""
    block = min((block_size(len(x), params) for x in patterns if len(x) >= params.min_overlap), default=0)
    if block < 4:
        return None
    rows = [pattern(x) for x in patterns]
    found = []
    for k, a in enumerate(rows):
        for offset in range(0, len(a) - block + 1, block):
            part = _CODE[a[offset : offset + block]]
            if (part < 4).all():
                found.append((int(part.astype(np.int64) @ 4 ** np.arange(block - 1, -1, -1)), k, offset))
    codes, which, offsets = np.array(sorted(found), np.int64).reshape(-1, 3).T
    wide = np.full((len(rows), max(map(len, rows))), 255, np.uint8)
    for k, a in enumerate(rows):
        wide[k, : len(a)] = a
    return SeedIndex(block, np.searchsorted(codes, np.arange(4**block + 1)), which, offsets, wide, np.array([len(a) for a in rows]), params)


def _candidates(m: np.ndarray, length: np.ndarray, a: np.ndarray, params: MatchParams, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) pairs that can match: an error-free block of the pattern stands near its place."""
    width = m.shape[1]
    room = np.arange(width) <= (length - max(params.min_overlap - band, 1))[:, None]
    b = block_size(len(a), params)
    if not b:
        return np.nonzero(room)
    near = np.zeros((m.shape[0], width), bool)
    for start in range(0, len(a) - b + 1, b):
        same = np.ones((m.shape[0], max(width - b + 1, 0)), bool)
        for j in range(b):
            same &= m[:, j : j + same.shape[1]] == a[start + j]
        for move in range(-band, band + 1):
            d = start + move  # a match starts so many places before the block
            if d >= 0:
                near[:, : max(same.shape[1] - d, 0)] |= same[:, d:]
            else:
                near[:, -d : -d + same.shape[1]] |= same[:, : width + d]
    return np.nonzero(near & room)


def edit_hits(m: np.ndarray, length: np.ndarray, a: np.ndarray, params: MatchParams, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best match at each (row, start): (errors or -1, overlap, consumed).

    A banded edit distance of the pattern's prefixes to what stands at the start; the first read base is never an
    insertion. A cell counts where the read or the pattern ends. Fewest errors, longest prefix, most read bases.
    """
    band = int(params.limit(np.arange(len(a) + 1)).max(initial=0))
    left = length[row] - start
    c, big = len(row), 10_000
    wide = np.zeros((m.shape[0], m.shape[1] + len(a) + band + 1), np.uint8)
    wide[:, : m.shape[1]] = m
    moves = np.arange(-band, band + 1)
    d = np.full((c, 2 * band + 1), big, np.int32)
    d[:, band] = 0
    best_e, best_i, best_j = np.full(c, -1), np.zeros(c, np.int64), np.zeros(c, np.int64)
    limits = params.limit(np.arange(len(a) + 1))
    for i in range(1, len(a) + 1):
        j = i + moves
        at = np.clip(start[:, None] + j - 1, 0, wide.shape[1] - 1)
        base = wide[row[:, None], at]
        inside = (j >= 0) & (j <= left[:, None])
        step = d + (base != a[i - 1])
        step[:, j < 1] = big
        new = step
        new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)  # a pattern base without read base
        new[~inside] = big
        for k in range(1, new.shape[1]):  # a read base without pattern base
            new[:, k] = np.where(inside[:, k], np.minimum(new[:, k], new[:, k - 1] + 1), big)
        d = new
        if i >= params.min_overlap:
            ends = np.where(i == len(a), inside, j == left[:, None])
            e = np.where(ends & (d <= limits[i]), d, big)
            for k in range(e.shape[1]):
                better = (e[:, k] < big) & ((best_e < 0) | (e[:, k] < best_e) | (e[:, k] == best_e) & ((i > best_i) | (i == best_i) & (j[k] > best_j)))
                best_e[better], best_i[better], best_j[better] = e[better, k], i, j[k]
    return best_e, best_i, best_j


def coordinate_hits(m: np.ndarray, length: np.ndarray, patterns: list[str], params: MatchParams) -> tuple[np.ndarray, ...]:
    """(row, start, errors, overlap, consumed, pattern): the best edit match at each start that has one: fewest errors, longest overlap, first declared."""
    found = []
    for k, sequence in enumerate(patterns):
        a = pattern(sequence)
        band = int(params.limit(np.arange(len(a) + 1)).max(initial=0))
        row, start = _candidates(m, length, a, params, band)
        e, i, j = edit_hits(m, length, a, params, row, start)
        ok = e >= 0
        found.append(np.stack([row[ok], start[ok], e[ok], i[ok], j[ok], np.full(ok.sum(), k)]))
    every = np.concatenate(found, 1) if found else np.zeros((6, 0), np.int64)
    row, start, e, i, j, k = every
    order = np.lexsort((k, -i, e, start, row))
    every = every[:, order]
    first = np.ones(every.shape[1], bool)
    first[1:] = (every[0, 1:] != every[0, :-1]) | (every[1, 1:] != every[1, :-1])
    return tuple(every[:, first])


def three_prime_indels(m: np.ndarray, length: np.ndarray, patterns: list[str], params: MatchParams) -> Hits:
    """The winner among the first start s with a match of e errors and those up to s + e: most overlap less errors,
    earliest, fewest errors, longest, first declared."""
    row, start, e, i, j, k = coordinate_hits(m, length, patterns, params)
    out = Hits.none(len(length))
    if not len(row):
        return out
    first = np.concatenate([[True], row[1:] != row[:-1]])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
    window = np.flatnonzero(start <= start[lead] + e[lead])
    order = window[np.lexsort((k[window], -i[window], e[window], start[window], -(i - e)[window], row[window]))]
    best = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
    out.put(row[best], start[best], e[best], i[best], j[best], k[best])
    return out


def five_prime(m: np.ndarray, length: np.ndarray, patterns: list[str], params: MatchParams, max_offset: int) -> list[Hits]:
    """For each pattern the first start up to `max_offset` where all of it matches; at 0 the read's end may cut it."""
    out = []
    for k, sequence in enumerate(patterns):
        a = pattern(sequence)
        hits = Hits.none(len(length))
        if params.allow_indels:
            row, start, e, i, j, _ = coordinate_hits(m, length, [sequence], params)
            fits = (start <= max_offset) & ((i == len(a)) | (start == 0))
            row, start, e, i, j = (x[fits] for x in (row, start, e, i, j))
            first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
            hits.put(row[first], start[first], e[first], i[first], j[first], k)
        elif m.shape[1]:
            ok, errors, overlap = accepted(m, length, a, params)
            place = np.arange(m.shape[1])
            ok &= (place <= max_offset) & ((overlap == len(a)) | (place == 0))
            p = ok.argmax(1)
            has = np.flatnonzero(ok[np.arange(len(p)), p])
            hits.put(has, p[has], errors[has, p[has]].astype(np.int64), overlap[has, p[has]], overlap[has, p[has]], k)
        out.append(hits)
    return out


def all_matches(m: np.ndarray, length: np.ndarray, patterns: list[str], params: MatchParams) -> tuple[np.ndarray, ...]:
    """(row, start, errors, overlap, consumed, pattern) of every match; by edits, the best of each start."""
    if params.allow_indels:
        return coordinate_hits(m, length, patterns, params)
    found = []
    for k, sequence in enumerate(patterns):
        ok, errors, overlap = accepted(m, length, pattern(sequence), params)
        row, start = np.nonzero(ok)
        o = overlap[row, start]
        found.append(np.stack([row, start, errors[row, start].astype(np.int64), o, o, np.full(len(row), k)]))
    every = np.concatenate(found, 1) if found else np.zeros((6, 0), np.int64)
    return tuple(every[:, np.lexsort((every[5], every[1], every[0]))])


# Linked flanks

MATCHED, NEITHER, FIVE_ONLY, THREE_ONLY, OUT_OF_ORDER, INSERT_TOO_SHORT = range(6)
LINKED_LABELS = ("matched", "neither", "five_only", "three_only", "out_of_order", "insert_too_short")


@dataclass(frozen=True)
class Linked:
    five: str
    three: str


@dataclass(frozen=True)
class LinkedParams:
    require: str = "both"  # or either
    max_five_offset: int = 3
    max_three_overhang: int | None = None
    min_insert: int = 1


#: How much a failure says; the first of the highest is reported.
SEVERITY = np.array([-1, 0, 1, 1, 2, 3])


@dataclass
class LinkedHits:
    """status, insert [start, end), definition, and whether its flanks were found; one a read."""

    status: np.ndarray
    start: np.ndarray
    end: np.ndarray
    which: np.ndarray
    five: np.ndarray
    three: np.ndarray


def linked(m: np.ndarray, length: np.ndarray, definitions: list[Linked], params: MatchParams, options: LinkedParams) -> LinkedHits:
    """The best definition of each read: both flanks, fewer errors, lower error rate, longer overlap, longer insert, first declared.

    The 3' flank is sought behind the 5' one, or from the read's start where there is none; one that hangs over the
    read's end too far fails. Without definitions every read is unmatched. As the 3' flank is sought behind the 5' one,
    out_of_order never arises; it stays a label that reports list.
    """
    n = len(length)
    out = LinkedHits(np.full(n, NEITHER), np.zeros(n, np.int64), length.copy(), np.full(n, -1), np.zeros(n, bool), np.zeros(n, bool))
    best = np.zeros((n, 5), np.int64)
    for k, definition in enumerate(definitions):
        five = five_prime(m, length, [definition.five], params, options.max_five_offset)[0]
        has5 = five.start >= 0
        begin = np.where(has5, five.start + five.consumed, 0)
        three = three_prime(shift(m, begin), length - begin, [definition.three], params)
        has3 = three.start >= 0
        stop = np.where(has3, begin + three.start, length)
        state = np.full(n, MATCHED)
        if options.require == "both":
            state[has5 & ~has3], state[has3 & ~has5] = FIVE_ONLY, THREE_ONLY
        state[~has5 & ~has3] = NEITHER
        state[(state == MATCHED) & (stop - begin < options.min_insert)] = INSERT_TOO_SHORT
        if options.max_three_overhang is not None:
            state[has3 & (len(definition.three) - (length - stop) > options.max_three_overhang)] = THREE_ONLY
        errors = five.errors + three.errors
        overlap = five.overlap + three.overlap
        rate = np.floor(errors / np.maximum(overlap, 1) * 1e9).astype(np.int64)
        key = np.stack([~(has5 & has3), errors, rate, -overlap, -(stop - begin)], 1).astype(np.int64)
        differ = key != best
        at = differ.argmax(1)
        less = differ.any(1) & (key[np.arange(n), at] < best[np.arange(n), at])
        win = (state == MATCHED) & ((out.status != MATCHED) | less)
        said = (state != MATCHED) & (out.status != MATCHED) & (SEVERITY[state] > SEVERITY[out.status])
        best[win] = key[win]
        for field, value in ((out.start, begin), (out.end, stop), (out.five, has5), (out.three, has3)):
            field[win] = value[win]
        out.which[win] = k
        out.status[win] = MATCHED
        out.status[said] = state[said]
    return out
