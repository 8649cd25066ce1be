"""Scalar primitives on sequences and qualities as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def phred(char: Column) -> Column:
    return F.greatest(F.lit(0), F.ascii(char) - 33)


def phred_sum(qual: Column) -> Column:
    """Sum of the qualities; 0 for an empty string."""
    return F.aggregate(F.split(qual, ""), F.lit(0), lambda a, c: a + F.when(c == "", 0).otherwise(phred(c))).cast("bigint")


def complement(seq: Column) -> Column:
    """A and T, C and G swapped; anything else N."""
    return F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def n_count(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))).cast("int")


def changes(seq: Column) -> Column:
    """Adjacent bases that differ."""
    bases = F.split(seq, "")
    same = F.zip_with(F.slice(bases, 1, F.greatest(F.length(seq) - 1, F.lit(0))), F.slice(bases, 2, F.greatest(F.length(seq) - 1, F.lit(0))), lambda a, b: F.when(a == b, 0).otherwise(1))
    return F.when(F.length(seq) < 2, 0).otherwise(F.aggregate(same, F.lit(0), lambda a, x: a + x)).cast("int")


def complexity(seq: Column) -> Column:
    """Changes over the most there could be; 0 below two bases."""
    return F.when(F.length(seq) < 2, F.lit(0.0)).otherwise(changes(seq) / F.greatest(F.length(seq) - 1, F.lit(1)))


def error_limit(overlap: Column, rate: float, cap: int | None = None) -> Column:
    """The double product, truncated, and the cap."""
    out = (overlap.cast("double") * F.lit(rate)).cast("int")
    return out if cap is None else F.least(out, F.lit(cap))


def fraction(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole, F.lit(0)))


def kmers(seq: Column, k: int) -> Column:
    """All substrings of k bases with ACGT only, in order."""
    at = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(at, lambda i: F.substr(seq, i, F.lit(k))), lambda x: ~x.rlike("[^ACGT]"))


def informative(kmer: Column, k: int, max_share: float = 0.75, min_complexity: float = 0.3) -> Column:
    """Not one base mostly, not a repeat of one to three bases, and not too simple."""
    most = F.greatest(*[F.length(kmer) - F.length(F.replace(kmer, F.lit(b), F.lit(""))) for b in "ACGT"])
    periodic = F.lit(False)
    for p in (1, 2, 3):
        periodic = periodic | (F.substr(kmer, F.lit(p + 1), F.lit(k - p)) == F.substr(kmer, F.lit(1), F.lit(k - p)))
    return (most <= max_share * k) & ~periodic & (complexity(kmer) >= min_complexity)


def span_trim(start: Column, end: Column, front: int, tail: int) -> tuple[Column, Column]:
    s = F.least(start + front, end)
    return s, F.greatest(end - tail, s)


def related(a: str, b: str, least: int = 12, rate: float = 0.1) -> bool:
    """Whether two sequences are one family: an ungapped slide over enough bases, or nearly equal by edits."""
    if not a or not b:
        return True
    short = min(len(a), len(b))
    required = min(max(least, short // 2), short)
    for offset in range(required - len(b), len(a) - required + 1):
        lo, hi = max(offset, 0), min(len(a), offset + len(b))
        if hi - lo >= required and sum(x != y for x, y in zip(a[lo:hi], b[lo - offset : hi - offset], strict=True)) <= rate * (hi - lo):
            return True
    limit = int(short * rate)
    return abs(len(a) - len(b)) <= limit and edit_distance(a, b) <= limit


def edits(a: Column, b: Column) -> Column:
    """The edit distance of two columns."""
    return F.levenshtein(a, b)


def edit_distance(a: str, b: str) -> int:
    """The edit distance of two short strings of the driver."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]
