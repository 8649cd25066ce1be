"""3' and 5' matches against plain loops, and golden cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from readloom.kernels import bytes as kb
from readloom.kernels import match as km
from readloom.kernels.match import Linked, LinkedParams, MatchParams
from readloom.sources import known

A33 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"
INF = 10**6


def find(reads, patterns, **params):
    m, n = kb.matrix(pa.array(reads, pa.string()))
    h = km.three_prime(m, n, patterns, MatchParams(**params))
    return [(s, e, o, k) if s >= 0 else None for s, e, o, k in zip(h.start.tolist(), h.errors.tolist(), h.overlap.tolist(), h.which.tolist(), strict=True)]


def slow(read, patterns, p):
    """Every place, every pattern."""
    hits = []
    for k, a in enumerate(patterns):
        for s in range(len(read) - p.min_overlap + 1):
            o = min(len(a), len(read) - s)
            e = sum(a[i] == "N" or a[i] != read[s + i] for i in range(o))
            if o >= p.min_overlap and e <= int(p.limit(o)):
                hits.append((s, e, -o, k))
    if not hits:
        return None
    s, e, o, k = min(hits)
    return s, e, -o, k


def slow_edit(read, a, s, p):
    """The best cell of a full table at one start: (errors, overlap, consumed)."""
    m = len(read) - s
    band = int(max(p.limit(np.arange(len(a) + 1))))
    d = [[INF] * (m + 1) for _ in range(len(a) + 1)]
    d[0][0] = 0
    best = None
    for i in range(len(a) + 1):
        for j in range(m + 1):
            if abs(i - j) > band or (i, j) == (0, 0):
                continue
            v = INF
            if i and j:
                v = min(v, d[i - 1][j - 1] + (a[i - 1] == "N" or a[i - 1] != read[s + j - 1]))
            if i:
                v = min(v, d[i - 1][j] + 1)
            if i and j:
                v = min(v, d[i][j - 1] + 1)
            d[i][j] = v
            if i >= p.min_overlap and (i == len(a) or j == m) and v <= int(p.limit(i)):
                best = min(best or (INF,), (v, -i, -j))
    return best and (best[0], -best[1], -best[2])


def slow_indel(read, patterns, p):
    at = {}
    for s in range(len(read)):
        cells = [(c[0], -c[1], k, c) for k, a in enumerate(patterns) if (c := slow_edit(read, a, s, p))]
        if cells:
            *_, k, c = min(cells)
            at[s] = (k, c)
    if not at:
        return None
    first = min(at)
    window = [s for s in at if s <= first + at[first][1][0]]
    s = min(window, key=lambda s: (-(at[s][1][1] - at[s][1][0]), s, at[s][1][0], -at[s][1][1], at[s][0]))
    return s, at[s][1][0], at[s][1][1], at[s][0]


def seqs(rng, n, low=0, high=50, alphabet="ACGT"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(low, high))) for _ in range(n)]


def planted(rng, patterns, n):
    out = []
    for _ in range(n):
        a = list(rng.choice(patterns)[: rng.randrange(4, 34)])
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(a))
            a[i : i + rng.randrange(2)] = rng.choice(["", "A", "CG", "N"])
        out.append(seqs(rng, 1)[0] + "".join(a) + (seqs(rng, 1, 0, 6)[0] if rng.random() < 0.4 else ""))
    return out


def test_golden():
    assert find(["T" * 20 + A33], [A33]) == [(20, 0, 33, 0)]
    assert find(["T" * 12 + A33[:8], "T" * 12 + A33[:7]], [A33]) == [(12, 0, 8, 0), None]
    assert find(["T" * 12 + A33[:20] + "T" * 40], [A33]) == [None]
    assert [int(MatchParams().limit(n)) for n in (8, 10, 33)] == [0, 1, 3]
    assert int(MatchParams(max_errors=2).limit(33)) == 2
    for damaged in (A33[:10] + "T" + A33[10:], A33[:10] + A33[11:]):
        assert find(["T" * 20 + damaged], [A33], allow_indels=True) == [(20, 1, 33, 0)]
    assert find(["", "ACG"], [A33]) == [None, None] and find([], [A33]) == []


@pytest.mark.parametrize("options", [{}, {"min_overlap": 3, "max_error_rate": 0.3}, {"max_errors": 1, "max_error_rate": 0.2}])
def test_substitutions_are_those_of_all_places(options):
    rng = random.Random(3)
    patterns = [A33, A33[1:20], "ACGNACGTAC", "CTGTCTCTTATACACATCT"]
    reads = planted(rng, patterns, 300) + seqs(rng, 50, alphabet="ACGTN")
    p = MatchParams(**options)
    assert find(reads, patterns, **options) == [slow(r, patterns, p) for r in reads]


@pytest.mark.parametrize("options", [{}, {"min_overlap": 5, "max_error_rate": 0.2}, {"max_errors": 1}])
def test_edits_are_those_of_the_full_table(options):
    rng = random.Random(4)
    patterns = [A33, "CTGTCTCTTATACACATCT"]
    reads = planted(rng, patterns, 120) + seqs(rng, 20)
    p = MatchParams(allow_indels=True, **options)
    assert find(reads, patterns, allow_indels=True, **options) == [slow_indel(r, patterns, p) for r in reads]


def test_all_matches_hold_the_winner():
    rng = random.Random(5)
    patterns = [A33[:14], "CTTACGGATCCAGG"]
    reads = planted(rng, patterns, 60)
    m, n = kb.matrix(pa.array(reads))
    row, start, *_ = km.all_matches(m, n, patterns, MatchParams())
    for i, r in enumerate(reads):
        want = sorted((s, k) for k, a in enumerate(patterns) for s in range(len(r)) if slow(r[:s] and r[s:] or r[s:], [a], MatchParams()) and slow(r[s:], [a], MatchParams())[0] == 0)
        assert sorted(start[row == i].tolist()) == sorted(s for s, _ in want)


def test_linked_flanks():
    five, three = "AGGTCAGTCTAC", "CTTACGGATCCA"
    insert = "GATTACAGATTACATTTGGG"
    reads = ["A" * 3 + five + insert + three, "A" * 4 + five + insert + three, five + insert, insert + three + "CCC", insert, five + three, five + insert + three[:9]]
    m, n = kb.matrix(pa.array(reads))
    run = lambda **o: km.linked(m, n, [Linked(five, three)], MatchParams(), LinkedParams(**o))
    label = lambda h: [km.LINKED_LABELS[s] for s in h.status]
    both = run()
    assert label(both) == ["matched", "three_only", "five_only", "three_only", "neither", "insert_too_short", "matched"]
    assert (both.start[0], both.end[0]) == (15, 35)
    assert label(run(require="either"))[:4] == ["matched"] * 4
    assert label(run(max_three_overhang=2))[6] == "three_only" and label(run(max_three_overhang=3))[6] == "matched"
    assert label(km.linked(m, n, [], MatchParams(), LinkedParams())) == ["neither"] * len(reads)
    longer = km.linked(m, n, [Linked(five, three), Linked(five, "GGGTTTCCCAAAT")], MatchParams(), LinkedParams(require="either"))
    assert longer.which[0] == 0 and longer.which[2] == 0


def test_the_index_loses_no_match(monkeypatch):
    rng = np.random.default_rng(5)
    library = [seq for _, seq, _ in known.entries()]
    letters = lambda n: "".join(rng.choice(list("ACGTN"), n, p=[0.24, 0.24, 0.24, 0.24, 0.04]))
    texts = []
    for i in range(600):
        a = list(library[rng.integers(len(library))])
        for _ in range(rng.integers(0, 6)):
            a[rng.integers(len(a))] = "ACGT"[rng.integers(4)]
        x = letters(rng.integers(0, 90)) + "".join(a)
        texts.append(x[: rng.integers(0, 130)] if i % 3 else letters(rng.integers(0, 20)))
    m, length = kb.matrix(pa.array(texts))
    for params in (km.MatchParams(), km.MatchParams(min_overlap=5), km.MatchParams(max_error_rate=0.15), km.MatchParams(max_errors=1), km.MatchParams(min_overlap=12, max_error_rate=0.05)):
        for patterns in (library, ["ACGTNACGTTTG", *library[:9], "ACG"]):
            assert km.seed_index(tuple(patterns), params) is not None
            for size in (1000, 400_000):
                monkeypatch.setattr(km, "PROPOSALS", size)
                fast = km.three_prime(m, length, patterns, params)
            monkeypatch.setattr(km, "INDEXED", 10**9)
            slow = km.three_prime(m, length, patterns, params)
            monkeypatch.setattr(km, "INDEXED", 6)
            assert (slow.start >= 0).sum() > 50
            for name in ("start", "errors", "overlap", "consumed", "which"):
                assert (getattr(fast, name) == getattr(slow, name)).all(), (name, params)
    assert km.seed_index(tuple(library), km.MatchParams(max_error_rate=0.4)) is None
