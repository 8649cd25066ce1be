"""Finding adapters without being told them: a sampled query in three passes, each a grouped sum.

1. Scan: library hits, searchable places, homopolymer tails, and k-mers of read tails.
2. Consensus: columns of votes around frequent k-mers and behind the inserts of overlapping pairs.
3. Verify: every candidate against every sampled read.

Only sums by library entry, seed column or candidate reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom import ship
from readloom.functions import scalars as fs
from readloom.kernels import bytes as kb
from readloom.kernels import match as km
from readloom.kernels import pair as kp
from readloom.kernels.match import MatchParams
from readloom.operators import sample as sampling
from readloom.schema import Presence
from readloom.sources.catalogue import Entry

TAIL, SHORTLIST, K, SEEDS, COLUMNS, MAX_PLACE = 60, 8, 10, 32, 60, 1024
ARTIFACT_SHARE, END_SLACK = 0.9, 3
MIN_VOTING, MIN_MAJORITY = 0.5, 0.6
LOW, MEDIUM, HIGH = "low", "medium", "high"
_RANK = {LOW: 0, MEDIUM: 1, HIGH: 2}


@dataclass(frozen=True)
class Gates:
    min_sample: int = 100
    min_supporting: int = 20
    min_support_fraction: float = 0.01
    min_length: int = 12
    max_base_share: float = 0.75
    min_complexity: float = 0.3
    min_tail_connected: float = 0.80
    min_tail_enrichment: float = 5.0
    min_consensus: int = 20
    max_mean_error: float = 0.10
    competitor_share: float = 0.5


@dataclass(frozen=True)
class SniffParams:
    sample: int = 262_144
    top: int = 5
    match: MatchParams = MatchParams()
    gates: Gates = Gates()

    def validate(self) -> SniffParams:
        if self.sample < 1 or self.top < 1:
            raise ValueError("sample and top must be at least 1")
        return self


def _shipped(df: DataFrame) -> DataFrame:
    ship.ensure(df.sparkSession)
    return df


def by_mate(reads: DataFrame) -> DataFrame:
    """(record_index, mate, seq) of every read."""
    has = Presence.of(reads)
    return reads.select("record_index", F.inline(F.array(*[F.struct(F.lit(f"R{m}").alias("mate"), F.col(f"r{m}_seq").alias("seq")) for m in has.mates])))


def tail_of(seq: Column) -> Column:
    return F.substr(seq, F.greatest(F.length(seq) - TAIL + 1, F.lit(1)), F.lit(TAIL))


def places(seq: Column, min_overlap: int) -> tuple[Column, Column]:
    """Starts that a match can have in the last 60 bases, and before them."""
    every = F.greatest(F.length(seq) - min_overlap + 1, F.lit(0))
    tail = F.least(F.lit(TAIL), F.length(seq), every)
    return tail, every - tail


def artifact(seq: Column, base: str) -> Column:
    tail = tail_of(seq)
    return (F.length(seq) >= TAIL) & (F.length(tail) - F.length(F.replace(tail, F.lit(base), F.lit(""))) >= ARTIFACT_SHARE * TAIL)


def scan_totals(mates: DataFrame, min_overlap: int) -> DataFrame:
    """Per mate: reads, searchable places in tail and body, and reads with homopolymer tails."""
    tail, body = places(F.col("seq"), min_overlap)
    return mates.groupBy("mate").agg(F.count("*").alias("sampled"), F.sum(tail).cast("bigint").alias("tail_positions"), F.sum(body).cast("bigint").alias("body_positions"), F.count_if(artifact(F.col("seq"), "A")).alias("poly_a"), F.count_if(artifact(F.col("seq"), "G")).alias("poly_g"))


_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = range(4)


def _distinct_kmers(m: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Codes of the distinct k-mers, of ACGT only, in the last 60 bases of each read, all reads one after another."""
    tail = kb.shift(m, np.maximum(length - TAIL, 0))[:, :TAIL]
    if tail.shape[1] < K:
        return np.zeros(0, np.int64)
    base = _CODE[tail]  # padding is no base either
    windows = base.shape[1] - K + 1
    code = np.zeros((len(base), windows), np.int32)
    bad = np.zeros((len(base), windows), bool)
    for j in range(K):
        part = base[:, j : j + windows]
        code = code << 2 | (part & 3)
        bad |= part == 4
    code[bad] = 4**K
    code.sort(axis=1)
    new = np.ones(code.shape, bool)
    new[:, 1:] = code[:, 1:] != code[:, :-1]
    return code[new & (code < 4**K)]


def tail_kmers(mates: DataFrame) -> DataFrame:
    """(mate, kmer, reads): tail k-mers, once a read; each task counts its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            of = np.array(batch.column("mate").to_pylist(), object)
            for mate in set(of.tolist()):
                m, length = kb.matrix(batch.column("seq").filter(pa.array(of == mate)))
                own = counts.setdefault(mate, np.zeros(4**K, np.int64))
                for part in kb.parts([length], len(length)):
                    own += np.bincount(_distinct_kmers(m[part], length[part]), minlength=4**K)
        for mate, own in counts.items():
            codes = np.flatnonzero(own)
            letters = np.frombuffer(b"ACGT", np.uint8)[(codes[:, None] >> (2 * np.arange(K - 1, -1, -1))) & 3]
            whole = np.zeros(len(codes), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([mate] * len(codes), pa.string()), kb.strings(letters, whole, whole + K), pa.array(own[codes])], ["mate", "kmer", "n"])

    counted = _shipped(mates.select("mate", "seq")).mapInArrow(run, "mate string, kmer string, n long")
    return counted.groupBy("mate", "kmer").agg(F.sum("n").alias("reads"))


def seeds(kmers: DataFrame, mate: str, least: int) -> DataFrame:
    """The 32 most frequent informative k-mers of a mate, ties in order of the alphabet."""
    fit = kmers.filter((F.col("mate") == mate) & (F.col("reads") >= max(least, 1)) & fs.informative(F.col("kmer"), K))
    return fit.orderBy(F.desc("reads"), "kmer").limit(SEEDS).select("kmer", "reads")


def library_hits(mates: DataFrame, library: dict[str, list[str]], params: MatchParams) -> DataFrame:
    """(mate, entry, reads): the one library entry credited to each read that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[tuple[str, int], int] = {}
        for batch in batches:
            of = np.array(batch.column("mate").to_pylist(), object)
            for mate, sequences in library.items():
                own = batch.column("seq").filter(pa.array(of == mate))
                m, length = kb.matrix(own)
                for part in kb.parts([length], len(length)):
                    which = km.three_prime(m[part], length[part], sequences, params).which
                    for k, n in zip(*np.unique(which[which >= 0], return_counts=True), strict=True):
                        tally[mate, int(k)] = tally.get((mate, int(k)), 0) + int(n)
        keys = sorted(tally)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([tally[k] for k in keys], pa.int64())], ["mate", "entry", "n"])

    return _shipped(mates.select("mate", "seq")).mapInArrow(run, "mate string, entry int, n long").groupBy("mate", "entry").agg(F.sum("n").alias("reads"))


def _vote(votes: np.ndarray, m: np.ndarray, length: np.ndarray, at: np.ndarray, step: int) -> None:
    """Adds the bases at `at`, `at + step`, ... to votes [columns, 4]."""
    place = at[:, None] + step * np.arange(votes.shape[0])
    inside = (place >= 0) & (place < length[:, None])
    base = np.take_along_axis(m, np.clip(place, 0, max(m.shape[1] - 1, 0)), 1) if m.shape[1] else np.zeros_like(place, np.uint8)
    for k, b in enumerate(b"ACGT"):
        votes[:, k] += ((base == b) & inside).sum(0)


def consensus_votes(mates: DataFrame, of: dict[str, list[str]]) -> DataFrame:
    """(mate, seed, side, col, base, n): columns right of the first place of each seed, from the seed on, and left of it.

    A row with col -1 has the reads that hold the seed.
    """
    fields = "mate string, seed string, side string, col int, base string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = {(mate, s): np.zeros((2, COLUMNS, 4), np.int64) for mate, ss in of.items() for s in ss}
        holds = dict.fromkeys(tally, 0)
        for batch in batches:
            own = np.array(batch.column("mate").to_pylist(), object)
            for mate, ss in of.items():
                texts = [x or "" for x in batch.column("seq").filter(pa.array(own == mate)).to_pylist()]
                m, length = kb.matrix(pa.array(texts, pa.string()))
                for s in ss:
                    at = np.array([x.find(s) for x in texts], np.int64)
                    has = np.flatnonzero(at >= 0)
                    holds[mate, s] += len(has)
                    _vote(tally[mate, s][0], m[has], length[has], at[has], 1)
                    _vote(tally[mate, s][1], m[has], length[has], at[has] - 1, -1)
        rows = [(mate, s, None, -1, None, n) for (mate, s), n in holds.items() if n]
        for (mate, s), votes in tally.items():
            rows += [(mate, s, ("right", "left")[side], int(c), "ACGT"[b], int(votes[side, c, b])) for side, c, b in zip(*np.nonzero(votes), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["mate", "seed", "side", "col", "base", "n"])

    return _shipped(mates.select("mate", "seq")).mapInArrow(run, fields).groupBy("mate", "seed", "side", "col", "base").agg(F.sum("n").alias("n"))


def overhang_votes(reads: DataFrame) -> DataFrame:
    """(mate, col, base, n): bases behind the insert of overlapping pairs with at least K of them; col -1 counts such reads."""
    fields = "mate string, col int, base string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes, voting = np.zeros((2, COLUMNS, 4), np.int64), [0, 0]
        for batch in batches:
            (m1, l1), (m2, l2) = kb.matrix(batch.column("r1_seq")), kb.matrix(batch.column("r2_seq"))
            for part in kb.parts([l1, l2], batch.num_rows):
                over = kp.overlap(m1[part], l1[part], m2[part], l2[part], kp.OverlapParams())
                for k, (m, length) in enumerate(((m1[part], l1[part]), (m2[part], l2[part]))):
                    boundary = np.minimum(over.insert, length)
                    has = np.flatnonzero(over.found & (length >= boundary + K))
                    voting[k] += len(has)
                    _vote(votes[k], m[has], length[has], boundary[has], 1)
        rows = [(f"R{k + 1}", -1, None, n) for k, n in enumerate(voting) if n]
        rows += [(f"R{k + 1}", int(c), "ACGT"[b], int(votes[k, c, b])) for k, c, b in zip(*np.nonzero(votes), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["mate", "col", "base", "n"])

    return _shipped(reads.select("r1_seq", "r2_seq")).mapInArrow(run, fields).groupBy("mate", "col", "base").agg(F.sum("n").alias("n"))


def majority(votes: dict[str, int], voting: int) -> str | None:
    """The base of a column with votes of half the reads and a share of 0.6 of them; ties go to A, C, G, T."""
    total = sum(votes.values())
    if not total or total < MIN_VOTING * voting:
        return None
    base = max("ACGT", key=lambda b: (votes.get(b, 0), -"ACGT".index(b)))
    return base if votes[base] >= MIN_MAJORITY * total else None


def read_off(right: dict[int, dict[str, int]], left: dict[int, dict[str, int]], voting: int) -> str:
    """Leftward until a column fails, then rightward until one fails or the whole has 60 bases."""
    out = ""
    for c in range(COLUMNS):
        base = majority(left.get(c, {}), voting)
        if base is None:
            break
        out = base + out
    for c in range(COLUMNS):
        base = majority(right.get(c, {}), voting)
        if base is None or len(out) >= COLUMNS:
            break
        out += base
    return out[:COLUMNS] if len(out) > COLUMNS else out


@dataclass
class Candidate:
    sequence: str
    known_name: str | None = None
    known_category: str | None = None
    library_index: int = 1 << 62
    sources: tuple[str, ...] = ()
    overlap_support: int = 0
    supporting: int = 0
    support_fraction: float = 0.0
    tail_connected: float = 0.0
    enrichment: float | None = 0.0
    median_start: int = 0
    median_to_end: int = 0
    exact: int = 0
    substitution: int = 0
    indel: int = 0
    mean_error: float = 0.0
    confidence: str = LOW


@dataclass
class MateReport:
    mate: str
    decision: str
    candidates: list[Candidate] = field(default_factory=list)
    sampled: int = 0
    informative: int = 0
    poly_a: int = 0
    poly_g: int = 0

    @property
    def recommended(self) -> Candidate | None:
        return next((c for c in self.candidates if c.confidence == HIGH), None)


def propose(shortlist: list[tuple[int, Entry, str]], consensus: list[str], overhang: str, overhang_reads: int) -> list[Candidate]:
    """Library entries, then what consensus adds: a relative strengthens the first it fits, others are new."""
    out = [Candidate(seq, e.name, e.category, k, ("known_database",)) for k, e, seq in shortlist]
    for seq, source, support in [*((s, "kmer_consensus", 0) for s in consensus), (overhang, "paired_overlap", overhang_reads)]:
        if len(seq) < K:
            continue
        kin = next((c for c in out if fs.related(c.sequence, seq)), None)
        if kin is None:
            out.append(Candidate(seq, sources=(source,), overlap_support=support))
        else:
            kin.sources = kin.sources if source in kin.sources else (*kin.sources, source)
            kin.overlap_support = max(kin.overlap_support, support)
    return out


def _whole_read(hits: km.Hits, m: np.ndarray, length: np.ndarray, seq: str, params: MatchParams) -> None:
    """Reads without a 3' match may be all adapter: the match laid at their start counts, by substitutions."""
    left = np.flatnonzero(hits.start < 0)
    if len(left) and m.shape[1]:
        ok, errors, overlap = km.accepted(m[left], length[left], km.pattern(seq), params)
        has = np.flatnonzero(ok[:, 0])
        o = overlap[has, 0]
        hits.put(left[has], 0, errors[has, 0].astype(np.int64), o, o, 0)


def verify(mates: DataFrame, candidates: dict[str, list[str]], params: MatchParams) -> DataFrame:
    """(mate, candidate, what, value, n): tallies of each candidate alone against every read.

    what: supporting, tail_connected, tail, body, exact, substitution, indel, errors, overlap (n is the sum), and
    start and distance (histograms by value).
    """
    fields = "mate string, candidate int, what string, value int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[tuple[str, int, str, int], int] = {}

        def add(mate: str, k: int, what: str, n: int, value: int = 0) -> None:
            if n:
                tally[mate, k, what, value] = tally.get((mate, k, what, value), 0) + int(n)

        for batch in batches:
            of = np.array(batch.column("mate").to_pylist(), object)
            for mate, sequences in candidates.items():
                m, length = kb.matrix(batch.column("seq").filter(pa.array(of == mate)))
                for k, seq in enumerate(sequences):
                    hits = km.three_prime(m, length, [seq], params)
                    _whole_read(hits, m, length, seq, params)
                    has = np.flatnonzero(hits.start >= 0)
                    start, errors, overlap, consumed, size = (x[has] for x in (hits.start, hits.errors, hits.overlap, hits.consumed, length))
                    add(mate, k, "supporting", len(has))
                    add(mate, k, "tail_connected", (start + len(seq) >= size).sum())
                    add(mate, k, "tail", (start + TAIL >= size).sum())
                    add(mate, k, "body", (start + TAIL < size).sum())
                    add(mate, k, "exact", (errors == 0).sum())
                    add(mate, k, "indel", ((errors > 0) & (consumed != overlap)).sum())
                    add(mate, k, "substitution", ((errors > 0) & (consumed == overlap)).sum())
                    add(mate, k, "errors", errors.sum())
                    add(mate, k, "overlap", overlap.sum())
                    for what, values in (("start", start), ("distance", size - start)):
                        for v, n in zip(*np.unique(np.minimum(values, MAX_PLACE), return_counts=True), strict=True):
                            add(mate, k, what, n, int(v))
        keys = list(tally)
        columns = list(zip(*keys, strict=True)) if keys else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip((*columns, [tally[x] for x in keys]), (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["mate", "candidate", "what", "value", "n"])

    return _shipped(mates.select("mate", "seq")).mapInArrow(run, fields).groupBy("mate", "candidate", "what", "value").agg(F.sum("n").alias("n"))


def median(histogram: dict[int, int]) -> int:
    """The least value with half the observations at or below it."""
    half, seen = (sum(histogram.values()) + 1) // 2, 0
    for value in sorted(histogram):
        seen += histogram[value]
        if seen >= half:
            return value
    return 0


def measured(c: Candidate, tally: dict[str, dict[int, int]], scan: dict[str, int], gates: Gates) -> Candidate:
    """The candidate with its metrics and confidence."""
    n = {what: sum(v.values()) for what, v in tally.items()}
    get = lambda what: n.get(what, 0)
    share = lambda part, whole: part / whole if whole else 0.0
    tail, body = share(get("tail"), scan["tail_positions"]), share(get("body"), scan["body_positions"])
    out = replace(
        c, supporting=get("supporting"), support_fraction=share(get("supporting"), scan["sampled"]), tail_connected=share(get("tail_connected"), get("supporting")),
        enrichment=tail / body if body > 0 else None if tail > 0 else 0.0, median_start=median(tally.get("start", {})), median_to_end=median(tally.get("distance", {})),
        exact=get("exact"), substitution=get("substitution"), indel=get("indel"), mean_error=share(get("errors"), get("overlap")),
    )
    out.confidence = confidence(out, scan["sampled"], gates)
    return out


def confidence(c: Candidate, sampled: int, g: Gates) -> str:
    """Low without enough reads, length, complexity or accuracy; high if also frequent and safe to trim by."""
    changes = sum(x != y for x, y in zip(c.sequence, c.sequence[1:], strict=False)) / max(len(c.sequence) - 1, 1)
    simple = max(map(c.sequence.count, set(c.sequence)), default=0) > g.max_base_share * len(c.sequence) or changes < g.min_complexity
    if sampled < g.min_sample or c.supporting < g.min_supporting or len(c.sequence) < g.min_length or simple or c.mean_error > g.max_mean_error:
        return LOW
    localized = c.tail_connected >= g.min_tail_connected
    enriched = c.enrichment is None or c.enrichment >= g.min_tail_enrichment
    reaches_end = max(c.median_to_end - len(c.sequence), 0) <= END_SLACK
    paired = c.overlap_support >= g.min_supporting
    extended = len(c.sequence) >= g.min_consensus and ("kmer_consensus" in c.sources or paired and "paired_overlap" in c.sources)
    known = c.known_name is not None
    safe = extended or (paired or reaches_end or localized if known else localized and enriched)
    if safe and c.support_fraction >= g.min_support_fraction:
        return HIGH
    return MEDIUM if safe or localized or enriched or known else LOW


def preference(c: Candidate) -> tuple:
    enrichment = float("inf") if c.enrichment is None else c.enrichment
    return (-_RANK[c.confidence], -c.supporting, -enrichment, -c.tail_connected, -len(c.sequence), c.mean_error, c.library_index, c.sequence)


def decide(candidates: list[Candidate], g: Gates) -> tuple[str, list[Candidate]]:
    """(inconclusive, mixed or confident, candidates in order): the best-supported of the first family leads, its
    relatives and weak rivals step down, strong rivals make it mixed."""
    ranked = sorted(candidates, key=preference)
    high = [c for c in ranked if c.confidence == HIGH]
    if not high:
        return "inconclusive", ranked
    family = [c for c in high if fs.related(high[0].sequence, c.sequence)] or high[:1]
    leader = min(family, key=lambda c: (-len(c.sources), -len(c.sequence), -c.supporting, ranked.index(c)))
    rivals = 0
    for c in high:
        if c is leader:
            continue
        if not fs.related(leader.sequence, c.sequence) and c.supporting >= g.competitor_share * max(leader.supporting, 1):
            rivals += 1
        else:
            c.confidence = MEDIUM
    return "mixed" if rivals else "confident", sorted(ranked, key=preference)


@dataclass
class AdapterReport:
    mates: list[MateReport]
    warnings: list[str]
    sampled: int

    @property
    def decision(self) -> str:
        order = ("confident", "inconclusive", "mixed")
        return max((m.decision for m in self.mates), key=order.index)


def sniff(reads: DataFrame, library: list[Entry], params: SniffParams = SniffParams()) -> AdapterReport:
    """The whole query: the sample is read from its source once, with only the columns that it needs, for all passes."""
    params.validate()
    has = Presence.of(reads)
    # read once: the sample has a bounded number of rows, and all passes share it
    rows = sampling.sample(reads.select("record_index", *[f"r{m}_seq" for m in has.mates]), params.sample).persist()
    try:
        return _sniff(rows, has, library, params)
    finally:
        rows.unpersist()


def _sniff(rows: DataFrame, has: Presence, library: list[Entry], params: SniffParams) -> AdapterReport:
    mates = by_mate(rows)
    names = [f"R{m}" for m in has.mates]
    sequences = {m: [e.sequence_of(m) for e in library] for m in names}
    empty = {"sampled": 0, "tail_positions": 0, "body_positions": 0, "poly_a": 0, "poly_g": 0}
    scans = dict.fromkeys(names, empty) | {r["mate"]: r.asDict() for r in scan_totals(mates, params.match.min_overlap).collect()}
    hits: dict[str, dict[int, int]] = {m: {} for m in names}
    for r in library_hits(mates, sequences, params.match).collect() if library else []:
        hits[r["mate"]][r["entry"]] = r["reads"]
    counted = tail_kmers(mates)
    chosen = {m: [r["kmer"] for r in seeds(counted, m, params.gates.min_supporting).collect()] for m in names}
    votes: dict[tuple, dict[int, dict[str, int]]] = {}
    voting: dict[tuple[str, str], int] = {}
    for r in consensus_votes(mates, chosen).collect():
        if r["col"] < 0:
            voting[r["mate"], r["seed"]] = r["n"]
        else:
            votes.setdefault((r["mate"], r["seed"], r["side"]), {}).setdefault(r["col"], {})[r["base"]] = r["n"]
    hang: dict[str, dict[int, dict[str, int]]] = {}
    hanging = dict.fromkeys(names, 0)
    for r in overhang_votes(rows).collect() if has.paired else []:
        if r["col"] < 0:
            hanging[r["mate"]] = r["n"]
        else:
            hang.setdefault(r["mate"], {}).setdefault(r["col"], {})[r["base"]] = r["n"]
    proposals = {}
    for m in names:
        short = sorted(hits[m], key=lambda k, m=m: (-hits[m][k], k))[:SHORTLIST]
        grown = [read_off(votes.get((m, s, "right"), {}), votes.get((m, s, "left"), {}), voting.get((m, s), 0)) for s in chosen[m]]
        proposals[m] = propose([(k, library[k], sequences[m][k]) for k in short], grown, read_off(hang.get(m, {}), {}, hanging[m]), hanging[m])
    tallies: dict[tuple[str, int], dict[str, dict[int, int]]] = {}
    for r in verify(mates, {m: [c.sequence for c in proposals[m]] for m in names}, params.match).collect():
        tallies.setdefault((r["mate"], r["candidate"]), {}).setdefault(r["what"], {})[r["value"]] = r["n"]
    reports = []
    for m in names:
        built = [measured(c, tallies.get((m, k), {}), scans[m], params.gates) for k, c in enumerate(proposals[m])]
        decision, ranked = decide(built, params.gates)
        reports.append(MateReport(m, decision, ranked[: params.top], scans[m]["sampled"], sum(hits[m].values()), scans[m]["poly_a"], scans[m]["poly_g"]))
    return AdapterReport(reports, warnings(reports, params), max((r.sampled for r in reports), default=0))


def warnings(reports: list[MateReport], params: SniffParams) -> list[str]:
    out = []
    for r in reports:
        if r.sampled < params.gates.min_sample:
            out.append(f"{r.mate}: only {r.sampled} reads")
        if r.decision == "mixed":
            out.append(f"{r.mate}: several unrelated adapters; the strongest is shown")
        for base, n in (("A", r.poly_a), ("G", r.poly_g)):
            if r.sampled and n > 0.5 * r.sampled:
                out.append(f"{r.mate}: more than half of the reads end in poly-{base}")
    return out
