"""Trims, filters, overlaps, correction and segments against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest

from readloom.kernels import bytes as kb
from readloom.kernels import pair as kp
from readloom.kernels import segment as ks
from readloom.kernels import trim as kt
from readloom.kernels.match import MatchParams
from readloom.kernels.trim import FilterParams, TrimParams


def trim(seq, qual=None, **options):
    m, n = kb.matrix(pa.array([seq]))
    q = kb.matrix(pa.array([qual or "I" * len(seq)]))[0]
    s, e, removed = kt.trim(m, q, np.zeros(1, np.int64), n.copy(), TrimParams(**options))
    assert 0 <= s[0] <= e[0] <= n[0] and removed.sum() == n[0] - (e[0] - s[0])
    return seq[s[0] : e[0]]


def test_golden_trims():
    assert trim("ACGTACGTACGT", "!!!!IIIIIIII", quality_front=20) == "GTACGTACGT"
    assert trim("ACGTACGTACGT", "IIII!!!!IIII", quality_right=20) == "ACG"
    assert trim("NNACGNTACNN", terminal_n=True) == "ACGNTAC"
    assert trim("ACTACTACTGGGGGGAGGGGG", poly_g=True) == "ACTACTACT"
    assert trim("ACGT", front=3, tail=9) == "" and trim("NNNN", terminal_n=True) == ""
    assert trim("ACGTACGT", max_length=3) == "ACG" and trim("ACGTAAAAAAAAAAAA", poly_x=True) == "ACG"


def slow_trim(seq, qual, p):
    s, e = min(p.front, len(seq)), len(seq)
    e = max(e - p.tail, s)
    q = [ord(c) - 33 for c in qual]
    if p.quality_front is not None:
        while s < e and sum(q[s : min(s + p.window, e)]) < p.quality_front * (min(s + p.window, e) - s):
            s += 1
    if p.quality_right is not None:
        w = min(p.window, e - s)
        e = next((i for i in range(s, e - w + 1) if w and sum(q[i : i + w]) < p.quality_right * w), e)
    if p.quality_tail is not None:
        while e > s and sum(q[max(e - p.window, s) : e]) < p.quality_tail * (e - max(e - p.window, s)):
            e -= 1
    if p.terminal_n:
        while s < e and seq[s] == "N":
            s += 1
        while s < e and seq[e - 1] == "N":
            e -= 1

    def poly(b):
        sizes = [i for i in range(p.poly_min, e - s + 1) if sum(c != b for c in seq[e - i : e]) <= i * p.poly_rate]
        return max(sizes, default=0)

    if p.poly_g:
        e -= poly("G")
    if p.poly_x:
        e -= max(map(poly, "ACGT"))
    return s, e if p.max_length is None else min(e, s + p.max_length)


def test_trims_are_those_of_plain_loops():
    rng = random.Random(1)
    for _ in range(60):
        p = TrimParams(front=rng.randrange(4), tail=rng.randrange(4), window=rng.randrange(1, 7), terminal_n=rng.random() < 0.5, poly_g=rng.random() < 0.5, poly_x=rng.random() < 0.5, poly_min=rng.randrange(3, 12), max_length=rng.choice([None, 5, 30]), **{rng.choice(["quality_front", "quality_right", "quality_tail"]): rng.choice([5, 20, 30])})
        seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.randrange(20))) + rng.choice("ACGTN") * rng.randrange(20) for _ in range(40)] + [""]
        quals = ["".join(chr(33 + rng.choice([2, 12, 25, 40])) for _ in s) for s in seqs]
        m, n = kb.matrix(pa.array(seqs))
        s, e, _ = kt.trim(m, kb.matrix(pa.array(quals))[0], np.zeros(len(seqs), np.int64), n.copy(), p)
        assert list(zip(s.tolist(), e.tolist(), strict=True)) == [slow_trim(a, b, p) for a, b in zip(seqs, quals, strict=True)], p


def reasons(seq, qual=None, **options):
    m, n = kb.matrix(pa.array([seq]))
    q = kb.matrix(pa.array([qual or "I" * len(seq)]))[0]
    bits = int(kt.reasons(m, q, np.zeros(1, np.int64), n, FilterParams(**options))[0])
    return [name for i, name in enumerate(kt.REASONS) if bits >> i & 1]


def test_every_reason_is_given():
    all_five = reasons("NNNN", "!!!!", min_length=10, max_n=2, max_unqualified_bases=1, min_mean_quality=20, min_complexity=0.5)
    assert all_five == ["TOO_SHORT", "TOO_MANY_N", "TOO_MANY_LOW_QUAL", "LOW_MEAN_QUAL", "LOW_COMPLEXITY"]
    assert reasons("", min_mean_quality=20, max_n_fraction=0.0, max_unqualified_fraction=0.0) == []
    assert reasons("AACC", min_complexity=0.34) == ["LOW_COMPLEXITY"] and reasons("AACC", min_complexity=0.33) == []
    assert reasons("A", min_complexity=0.1) == ["LOW_COMPLEXITY"] and reasons("ACGTAC", length_limit=5) == ["TOO_LONG"]


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def slow_overlap(r1, r2, p):
    rc, best = revcomp(r2), None
    for o in range(p.min_overlap - len(r2), len(r1) - p.min_overlap + 1):
        lo, hi = max(o, 0), min(len(r1), o + len(r2))
        n = hi - lo
        e = sum(r1[i] != rc[i - o] or r1[i] == "N" for i in range(lo, hi))
        if n >= p.min_overlap and e <= int(n * p.max_error_rate):
            best = min(best or (0, 0, 0), (-n, e, o)) if best else (-n, e, o)
    return best and (best[2], -best[0], best[1])


def test_overlaps_are_those_of_all_offsets():
    rng = random.Random(2)
    pairs = []
    for _ in range(200):
        insert = "".join(rng.choice("ACGT") for _ in range(rng.randrange(20, 90)))
        tail = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randrange(40)))
        a, b = list((insert + tail())[: rng.randrange(30, 70)]), list((revcomp(insert) + tail())[: rng.randrange(30, 70)])
        for x in (a, b):
            for _ in range(rng.randrange(3)):
                x[rng.randrange(len(x))] = rng.choice("ACGTN")
        pairs.append(("".join(a), "".join(b)))
    pairs += [("", "ACGT" * 10), ("ACAC" * 20, "GTGT" * 20)]
    for p in (kp.OverlapParams(), kp.OverlapParams(10, 0.2)):
        (m1, n1), (m2, n2) = (kb.matrix(pa.array([x[k] for x in pairs])) for k in (0, 1))
        got = kp.overlap(m1, n1, m2, n2, p)
        assert [(o, n, e) if f else None for f, o, n, e in zip(got.found, got.offset, got.length, got.mismatches, strict=True)] == [slow_overlap(*x, p) for x in pairs]


def test_insert_lengths():
    rng = random.Random(8)
    for insert, want in ((100, (100, 100)), (200, (200, 60))):
        dna = "".join(rng.choice("ACGT") for _ in range(insert))
        tail = "".join(rng.choice("ACGT") for _ in range(130))
        (m1, n1), (m2, n2) = (kb.matrix(pa.array([(s + tail)[:130]])) for s in (dna, revcomp(dna)))
        o = kp.overlap(m1, n1, m2, n2, kp.OverlapParams())
        assert (o.insert[0], o.length[0]) == want


def test_correction_changes_only_what_it_may():
    rng = random.Random(9)
    r1s, q1s, r2s, q2s = [], [], [], []
    for _ in range(150):
        dna = "".join(rng.choice("ACGT") for _ in range(60))
        a, b = list(dna), list(revcomp(dna))
        qa, qb = (["I"] * 60 for _ in range(2))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(60)
            a[i] = rng.choice("ACGTN")
            qa[i], qb[59 - i] = rng.choice("+I5"), rng.choice("+I5")
        r1s.append("".join(a)), q1s.append("".join(qa)), r2s.append("".join(b)), q2s.append("".join(qb))
    (m1, n1), (q1, _), (m2, n2), (q2, _) = (kb.matrix(pa.array(x)) for x in (r1s, q1s, r2s, q2s))
    over = kp.overlap(m1, n1, m2, n2, kp.OverlapParams())
    edits = kp.correct(m1, q1, n1, m2, q2, n2, over, kp.CorrectionParams())
    new = kp.apply(m1, q1, m2, q2, edits)
    wrong = unresolved = skipped = 0
    for r in np.flatnonzero(over.found):
        for i in range(60):
            j = 59 - i
            if r1s[r][i] == revcomp(r2s[r][j]) and r1s[r][i] != "N":
                assert chr(new[0][r, i]) == r1s[r][i] and chr(new[2][r, j]) == r2s[r][j]
                continue
            x, y = ord(q1s[r][i]) - 33, ord(q2s[r][j]) - 33
            if y >= 30 and x <= 14:
                wrong += 1
                assert chr(new[0][r, i]) == revcomp(r2s[r][j]) and new[1][r, i] == ord(q2s[r][j])
            elif x >= 30 and y <= 14:
                skipped += r1s[r][i] == "N"
                wrong += r1s[r][i] != "N"
                assert chr(new[2][r, j]) == (revcomp(r1s[r][i]) if r1s[r][i] != "N" else r2s[r][j])
            else:
                unresolved += 1
    assert (len(edits.row), edits.unresolved.sum(), edits.noncanonical.sum()) == (wrong, unresolved, skipped) and wrong > 10
    order = list(zip(edits.row, edits.mate, edits.position, strict=True))
    assert order == sorted(order)


def cut(reads, delimiters, min_overlap=8, **options):
    m, n = kb.matrix(pa.array(reads))
    return ks.segment(m, n, delimiters, MatchParams(min_overlap=min_overlap), ks.SegmentParams(**options))


def test_segments():
    a, b = "AGGTCAGTCTACAT", "CTTACGGATCCAGG"
    piece = "GATTACAGATTACC"
    f = cut([piece + a + piece + b + piece, a + piece, piece], [a, b])
    assert list(zip(f.row.tolist(), f.index.tolist(), f.start.tolist(), f.end.tolist(), f.left.tolist(), f.right.tolist(), strict=True)) == [(0, 0, 0, 14, -1, 0), (0, 1, 28, 42, 0, 1), (0, 2, 56, 70, 1, -1), (1, 0, 14, 28, 0, -1), (2, 0, 0, 14, -1, -1)]
    assert f.empty.tolist() == [0, 1, 0]
    d = cut([piece + a + piece + b + piece, piece], [a, b], terminal="discard")
    assert d.row.tolist() == [0] and d.terminal.tolist() == [2, 1]
    many = cut([(piece + a) * 12 + piece], [a], max_fragments=5)
    assert len(many.row) == 5 and many.over_limit.tolist() == [8]
    assert cut(["AT" + a + "AT"], [a], min_length=3).short.tolist() == [2]


@pytest.mark.parametrize("seed", range(5))
def test_fragments_tile_what_delimiters_leave(seed):
    rng = random.Random(seed)
    a = "AGGTCAGTCTACAT"
    reads = ["".join(rng.choice([a, a[:7] + "T" + a[8:], "".join(rng.choice("ACGT") for _ in range(rng.randrange(30)))]) for _ in range(rng.randrange(6))) for _ in range(40)]
    f = cut(reads, [a])
    for r in range(len(reads)):
        own = [(s, e) for i, s, e in zip(f.row, f.start, f.end, strict=True) if i == r]
        assert own == sorted(own) and all(x[1] <= y[0] for x, y in zip(own, own[1:], strict=False))
        assert len(own) + f.empty[r] == f.delimiters[r] + 1
