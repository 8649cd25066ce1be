"""LM scoring by a probabilistic suffix tree over the bytes of a text's tokens.

A text is its tokens: lower-cased words, then an end. The tree reads their bytes, a blank
after each word and an end mark; contexts are the bytes before, up to `DEPTH`, none of them
across documents.

Learning: counts of all runs of DEPTH + 1 bytes are summed over the training documents and
give those of every shorter context. A context is a candidate if it occurs twice as often as
the cube root of all positions (in a small corpus, at `SMALL` of them), so the tree may grow
with the two-thirds power of the corpus, and is retained, with its suffixes, if its next bytes diverge from its parent's: count times
Kullback-Leibler divergence of at least `GAIN` nats. Contexts of one byte are always states.
Next-byte distributions are smoothed towards the parent's, the more so the more different
bytes were seen (Witten and Bell). Scoring uses the longest suffix that is a state.

A tree of any size is scored in parts of about `MAX_MOVES` (context, byte) pairs, each the
contexts whose last two bytes lie in a range: a position asks only contexts with its own
last two bytes, so one part has all that it needs. A part is grown on the driver and sent to
the executors, which score its positions; the sums of all parts are added up by document.

The unigram base needs the count of every word, which has no bound: words above `HEAVY` of
all tokens (at most 1 / HEAVY of them) are sent to the executors, and other words of a
text are joined to the table of counts, so no common word makes a large group.

Defined cases: null text is empty, its only token the end; null ids are kept and count as
the empty string for the fold; repeated rows count and are scored each; without training
documents every next byte is equally likely; an empty table gives an empty result; very long
texts are read whole; other columns are not read. Words are counted by a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm import shared, words
from readloom.llm.words import U64, mix, runs

FOLDS, ALPHA = 10, 0.1
DEPTH, GAIN, PULL = 6, 5.0, 2.0
#: Share of positions that makes a candidate in a corpus of less than (SMALL / 2) ** -1.5 of them, about 250 million.
SMALL = 5e-6
#: (context, byte) pairs that the driver holds and sends at once.
MAX_MOVES = 3_000_000
HEAVY = 2.0**-21
START, BLANK, END = 0x09, 0x20, 0x0A  # never inside a word
END_WORD = words.word_hash("\n")
#: Distinct entries after which a task adds up what it has gathered.
COMPACT = 3_000_000
GRAM_BYTES = DEPTH + 1
#: Rows of a slice: a row's number takes what a gram leaves of 64 bits.
ROWS = 1 << (64 - 8 * GRAM_BYTES)


def stream(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, row) of each row's bytes: START * DEPTH, words with a blank after each, END."""
    counts = w.counts()
    size = (w.end - w.start) + 1
    n = DEPTH + 1 + np.bincount(w.row, size, w.rows).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(n)])
    out = np.full(int(base[-1]), BLANK, np.uint8)
    before = np.cumsum(size) - size
    of_row = before[np.minimum(np.cumsum(counts) - counts, max(len(size) - 1, 0))] if len(size) else np.zeros(w.rows, np.int64)
    at = base[w.row] + DEPTH + before - of_row[w.row]
    length = w.end - w.start
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at, length) + inside] = w.data[np.repeat(w.start, length) + inside]
    for j in range(DEPTH):
        out[base[:-1] + j] = START
    out[base[1:] - 1] = END
    return out, np.repeat(np.arange(w.rows), n)


def grams(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of each position: the DEPTH bytes before, then the byte, as one number."""
    symbols, row = stream(w)
    code = np.zeros(max(len(symbols) - DEPTH, 0), U64)
    for j in range(GRAM_BYTES):
        code = (code << U64(8)) | symbols[j : j + len(code)]
    own = row[DEPTH:]
    keep = row[: len(own)] == own
    return code[keep], own[keep]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, words.Words]]:
    for batch in batches:
        data, offsets = words.text_buffers(batch.column("text"))
        for x, y in words.slices(offsets):
            for a in range(x, y, ROWS):
                b = min(y, a + ROWS)
                yield batch, a, b, words.split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words.NOT_SPACE, lower=True)


class Tally:
    """Counts by 64-bit code, added up now and then."""

    def __init__(self) -> None:
        self.code, self.n, self.pending = [], [], 0

    def add(self, code: np.ndarray, n: np.ndarray | None = None) -> None:
        if n is None:
            code = np.sort(code)
            first, n = runs(code)
            code = code[first]
        self.code.append(code)
        self.n.append(n)
        self.pending += len(code)
        if self.pending > COMPACT:
            self.compact()
            self.pending = self.pending if self.pending > COMPACT // 2 else 0

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        code = np.concatenate([np.zeros(0, U64), *self.code])
        n = np.concatenate([np.zeros(0, np.int64), *self.n])
        order = np.argsort(code)
        first, _ = runs(code[order])
        n = np.add.reduceat(n[order], first) if len(first) else n
        self.code, self.n, self.pending = [code[order][first]], [n], 0
        return self.code[0], self.n[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word and gram counts of a task; full tallies are passed on at once."""
    tallies = (Tally(), Tally())

    def out(kind: int) -> Iterator[pa.RecordBatch]:
        code, n = tallies[kind].compact()
        for a in range(0, len(code), 200_000):
            part = code[a : a + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part.view(np.int64)), pa.array(n[a : a + 200_000])], ["kind", "code", "n"])
        tallies[kind].code, tallies[kind].n = [], []

    for _, a, b, w in _rows(batches):
        tallies[0].add(w.hash)
        tallies[0].add(np.array([END_WORD], U64), np.array([b - a], np.int64))
        tallies[1].add(grams(w)[0])
        for kind in (0, 1):
            if sum(map(len, tallies[kind].code)) > COMPACT:
                yield from out(kind)
    for kind in (0, 1):
        yield from out(kind)


@dataclass
class Level:
    """States of one depth, as sorted contexts with what a byte unseen there keeps of its parent's probability; and
    the bytes seen, as sorted (context << 8 | byte) with their smoothed probability."""

    context: np.ndarray
    keep: np.ndarray
    move: np.ndarray
    p: np.ndarray


@dataclass
class Tree:
    levels: list[Level]
    root: np.ndarray  # 256 probabilities

    def probability(self, code: np.ndarray) -> np.ndarray:
        """P(last byte | longest retained suffix of the bytes before) of distinct gram codes, from the longest down."""
        p = np.ones(len(code))
        rest = np.arange(len(code))
        for d in range(len(self.levels), 0, -1):
            level, own = self.levels[d - 1], code[rest] & U64((1 << 8 * (d + 1)) - 1)
            if not len(level.context):
                continue
            at, seen = lookup(level.move, own)
            p[rest[seen]] *= level.p[at[seen]]
            rest, own = rest[~seen], own[~seen]
            at, is_state = lookup(level.context, own >> U64(8))
            p[rest[is_state]] *= level.keep[at[is_state]]
        p[rest] *= self.root[(code[rest] & U64(255)).astype(np.int64)]
        return p


def lookup(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each x in sorted keys."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def grow(candidates: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], root: np.ndarray) -> Tree:
    """The tree from the candidates of each depth as (context, byte, count): a divergence test of each against its
    parent, then the suffixes of what is retained."""
    tree = Tree([], root)
    gains: list[np.ndarray] = []
    for context, byte, count in candidates:
        move = (context << U64(8)) | byte.astype(U64)
        order = np.argsort(move)
        move, count, context = move[order], count[order], context[order]
        names, state = np.unique(context, return_inverse=True)
        n = np.bincount(state, count, len(names))
        above = tree.probability(move)
        pull = PULL * np.bincount(state, minlength=len(names))  # by how many bytes were seen there
        own = (count + pull[state] * above) / (n[state] + pull[state])
        gains.append(np.bincount(state, count * np.log(own / above), len(names)))
        tree.levels.append(Level(names, pull / (n + pull), move, own))
    wanted = [g >= GAIN if d else np.ones(len(g), bool) for d, g in enumerate(gains)]
    for d in range(len(tree.levels) - 1, 0, -1):
        at, found = lookup(tree.levels[d - 1].context, tree.levels[d].context[wanted[d]] & U64((1 << 8 * d) - 1))
        wanted[d - 1][at[found]] = True
    for level, retained in zip(tree.levels, wanted, strict=True):
        live = retained[lookup(level.context, level.move >> U64(8))[0]] if len(level.move) else np.zeros(0, bool)
        level.move, level.p = level.move[live], level.p[live]
        level.context, level.keep = level.context[retained], level.keep[retained]
    return tree


@dataclass
class Model:
    candidates: DataFrame  # depth int, context long, byte short, n long
    root: np.ndarray
    parts: list[tuple[int, int]]  # ranges of the last two bytes of contexts
    counts: DataFrame  # word long, n long
    heavy: tuple[np.ndarray, np.ndarray]
    tokens: int
    types: int

    def tree(self, part: tuple[int, int]) -> Tree:
        """The states for positions whose last two bytes are in the range."""
        rows = self.candidates
        if len(self.parts) > 1:
            last = F.col("context").bitwiseAND(0xFFFF)
            rows = rows.filter((F.col("depth") == 1) | (last >= part[0]) & (last < part[1]))

        def depths() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:  # one at a time on the driver
            for d in range(1, DEPTH + 1):
                got = rows.filter(F.col("depth") == d).select("context", "byte", "n").toArrow()
                yield got["context"].to_numpy().view(U64), got["byte"].to_numpy(), got["n"].to_numpy()

        return grow(depths(), self.root)


def fit(train: DataFrame) -> Model:
    """A model of the texts of `train`."""
    spark = train.sparkSession
    shared.small_batches(spark, 2000)
    counts = train.select("text").mapInArrow(_count, "kind byte, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))
    counts = shared.materialize(counts, "counts")
    word, gram = counts.filter("kind = 0").select(F.col("code").alias("word"), "n"), counts.filter("kind = 1").select("code", "n")
    total = word.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    heavy = word.filter((F.col("n") >= HEAVY * total["n"]) & (F.lit(total["n"]) > 0)).toArrow()  # 1 / HEAVY rows at most
    code, n = heavy["word"].to_numpy().view(U64), heavy["n"].to_numpy()
    order = np.argsort(code)
    return Model(*_candidates(gram), word, (code[order], n[order]), int(total["n"]), int(total["v"]))


def least_count(positions: float) -> int:
    """Sightings that make a context a candidate: twice the cube root of the positions, in a small corpus a share of them."""
    return max(2, math.floor(min(SMALL * positions, 2 * positions ** (1 / 3)) + 1e-6))


def _candidates(gram: DataFrame) -> tuple[DataFrame, np.ndarray, list[tuple[int, int]]]:
    """Candidates of every depth, as sums over the longest contexts, the root's probabilities, and the parts of the tree."""
    deepest = gram.select(F.shiftrightunsigned("code", 8).alias("context"), F.col("code").bitwiseAND(255).alias("byte"), "n")
    levels = [deepest]
    for d in range(DEPTH - 1, -1, -1):
        shorter = levels[-1].select(F.col("context").bitwiseAND((1 << 8 * d) - 1).alias("context"), "byte", "n")
        levels.append(shared.materialize(shorter.groupBy("context", "byte").agg(F.sum("n").alias("n")), "contexts"))
    bytes_seen = levels[-1].collect()  # 256 at most
    seen = np.zeros(256)
    for r in bytes_seen:
        seen[r["byte"]] += r["n"]
    total = seen.sum()
    root = (seen + 1.0) / (total + 256.0)
    found = None
    for depth, level in enumerate(levels[-2::-1], 1):
        often = level.groupBy("context").agg(F.sum("n").alias("t")).filter(F.col("t") >= least_count(float(total))).select("context")
        own = level.join(often, "context").select(F.lit(depth).alias("depth"), "context", F.col("byte").cast("short").alias("byte"), "n")
        found = own if found is None else found.unionByName(own)
    found = shared.materialize(found, "candidates")
    return found, root, _parts(found)


def _parts(candidates: DataFrame) -> list[tuple[int, int]]:
    """Ranges of last two bytes with about MAX_MOVES candidates each."""
    if candidates.count() <= MAX_MOVES:
        return [(0, 1 << 16)]
    sizes = np.zeros(1 << 16, np.int64)
    for r in candidates.filter("depth > 1").groupBy(F.col("context").bitwiseAND(0xFFFF).alias("last")).agg(F.count("*").alias("n")).collect():  # 65,536 rows at most
        sizes[r["last"]] = r["n"]
    part = np.cumsum(sizes) // MAX_MOVES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), 1 << 16]
    return list(zip(edges[:-1], edges[1:], strict=True))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score, score (both log10 of the text's probability)."""
    spark = docs.sparkSession
    shared.small_batches(spark, 2000)
    floor = float(model.tokens + ALPHA * (model.types + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = None
    if len(model.parts) > 1:  # several passes must name rows alike
        docs, key = shared.numbered(docs.select("doc_id", "text"), "rows")
    fields = f"doc_id {kind}, uid long, word long, tf long, n_tokens long, n_known long, base double, score double"
    parts = None
    for k, part in enumerate(model.parts):
        sent = spark.sparkContext.broadcast((model.tree(part), model.heavy))  # both of bounded size
        own = docs.select("doc_id", "text", *([key] if key else [])).mapInArrow(_score(sent, part, k == 0, floor, key), fields)
        own = own if len(model.parts) == 1 else shared.materialize(own, "scores")
        parts = own if parts is None else parts.unionByName(own)
    joined = parts.join(model.counts, "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    known = F.when(F.col("tf").isNull(), F.col("n_known")).when(c > 0, F.col("tf")).otherwise(0)
    base = F.when(F.col("tf").isNull(), F.col("base")).otherwise(F.col("tf") * F.log10((c + ALPHA) / F.lit(floor)))
    summed = joined.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(base).alias("base_score"), F.sum("score").alias("score"))
    return summed.drop("uid")


def _score(sent: Broadcast, part: tuple[int, int], first_pass: bool, floor: float, key: str | None):
    """Rows of a pass: each document's sums, and in the first pass its rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tree, (heavy, heavy_n) = sent.value
        uid = TaskContext.get().partitionId() << 33
        end_at, end_known = lookup(heavy, np.array([END_WORD], U64))
        end_n = int(heavy_n[end_at[0]]) if end_known[0] else None
        for batch, a, b, w in _rows(batches):
            rows = b - a
            own = np.asarray(batch.column(key).slice(a, rows)) if key else uid + np.arange(rows)
            uid += rows
            code, of = grams(w)
            if part != (0, 1 << 16):
                last = (code >> U64(8)) & U64(0xFFFF)
                mine = (last >= U64(part[0])) & (last < U64(part[1]))
                code, of = code[mine], of[mine]
            packed = np.sort((code << U64(64 - 8 * GRAM_BYTES)) | of.astype(U64))
            first, times = runs(packed)
            gram = packed[first] >> U64(64 - 8 * GRAM_BYTES)
            start, many = runs(gram)
            logs = np.repeat(np.log10(tree.probability(gram[start])), many)
            total = np.bincount((packed[first] & U64(ROWS - 1)).astype(np.int64), logs * times, rows).astype(float)
            ids = batch.column("doc_id").slice(a, rows)
            spread = mix(own.astype(U64)).view(np.int64)
            if not first_pass:
                none = np.zeros(rows, np.int64)
                yield _batch(ids, own, spread, None, none, none, none.astype(float), total)
                continue
            order = np.argsort(w.hash)
            first, size = runs(w.hash[order])
            at, known = lookup(heavy, w.hash[order[first]])
            n = np.repeat(np.where(known, heavy_n[at] if len(heavy_n) else 0, -1), size)
            row = w.row[order]
            sure = n >= 0
            base = np.bincount(row[sure], np.log10((n[sure] + ALPHA) / floor), rows).astype(float)
            n_known = np.bincount(row[sure], minlength=rows)
            if end_n is not None:
                base += np.log10((end_n + ALPHA) / floor)
                n_known += 1
            rare_row, rare = row[~sure], w.hash[order][~sure]
            if end_n is None:
                rare_row, rare = np.concatenate([rare_row, np.arange(rows)]), np.concatenate([rare, np.full(rows, END_WORD, U64)])
            yield _batch(ids, own, spread, None, w.counts() + 1, n_known, base, total)
            if len(rare):
                by = np.lexsort((rare, rare_row))
                first, tf = runs(mix(rare[by]) ^ mix(rare_row[by].astype(U64)))
                r, h = rare_row[by][first], rare[by][first]
                yield _batch(ids.take(pa.array(r)), own[r], h.view(np.int64), tf, None, None, None, None)

    return run


def _batch(ids: pa.Array, uid: np.ndarray, word: np.ndarray, tf: np.ndarray | None, *rest: np.ndarray | None) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    column = lambda x, t: pa.nulls(len(uid), t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays([ids, pa.array(uid), pa.array(word), column(tf, pa.int64()), *map(column, rest, kinds)], ["doc_id", "uid", "word", "tf", "n_tokens", "n_known", "base", "score"])


def held_out() -> Column:
    return shared.crc_mod(F.col("doc_id"), FOLDS) == 0
