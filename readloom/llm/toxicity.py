"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of labelled documents, at most `PER_CLASS` of each class, the
first by a hash of their id; so what is sent to executors is bounded by the texts of that
sample, whatever the size of the corpus. Terms are lower-cased words and the first four and five bytes
of longer ones, which stand for stems. The feature space is those terms whose presence
depends on the label among the examples (a likelihood ratio of at least `LEAST_G`); inverse
document frequencies are counted over all documents. The index
holds examples in blocks of 64 with, for each term, its postings in the block and its
greatest weight there. A text visits blocks in order of their upper bounds and stops where
no bound reaches its k-th best similarity, so the k nearest are exact.

Texts without any of those terms are held against all terms of all examples, also without
loss: postings of rare terms first, then the examples that what is left can still lift
among the k nearest. Terms that no example has count in the text's norm as those of one document.

The share of toxic neighbours, weighted by a power of their similarity and against a
constant weight that far neighbours do not outweigh, becomes a
probability by a logistic curve fitted on the examples' own leave-one-out votes, weighted
to the classes' true shares. The neighbours are the evidence.

Defined cases: null text is empty; a text without any term of an example gets the
share of toxic ones among examples outside the feature space; null labels count as none and repeated ones as toxic if any is; with no labels of
a class all scores are the other's; null ids are kept, repeated rows scored alike; an
empty table gives an empty result; very long texts are read whole; ties of similarity go to
the earlier example; other columns are carried as `keep` says. Labels, languages and ids are
no inputs of a score; an example's id only keeps it from being its own neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import shared, words
from readloom.llm.words import U64

#: Documented bound of the sample that the classifier is fitted on.
PER_CLASS = 2000
NEIGHBOURS, POWER, BLOCK, LEAST_G = 15, 2.0, 64, 15.0
#: Weight of a neighbour that is not toxic and not there: far neighbours alone prove little.
ABSENT = 1.0
PREFIXES = (4, 5)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word, and of the first bytes of words longer than them."""
    w = words.split(data, offsets, words.ALNUM, lower=True)
    row, term = [w.row], [w.hash]
    for k in PREFIXES:
        long = np.flatnonzero(w.end - w.start > k)
        row.append(w.row[long])
        term.append(words.mix(words.hash_ranges(w.data, w.start[long], w.start[long] + k) ^ U64(k)))
    return np.concatenate(row), np.concatenate(term)


def term_counts(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count): distinct terms of each row, in order; terms are hashes, or places in the sorted `vocabulary`."""
    row, term = terms_of(data, offsets)
    if vocabulary is None:
        order = np.lexsort((term, row))
        row, term = row[order], term[order]
        first, count = words.runs(words.mix(term ^ words.mix(row.astype(U64))))
        return row[first], term[first], count
    if not len(vocabulary):
        return row[:0], row[:0], row[:0]
    at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
    known = vocabulary[at] == term
    key = np.sort(row[known] * len(vocabulary) + at[known])
    first, count = words.runs(key)
    return key[first] // len(vocabulary), key[first] % len(vocabulary), count


def select(terms: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Sorted terms whose presence depends on the label, by the likelihood ratio of the two-by-two table."""
    sizes = np.array([(label == c).sum() for c in (0, 1)], float)
    if not len(terms) or not sizes.all():
        return np.zeros(0, U64)
    every, at = np.unique(np.concatenate(terms), return_inverse=True)
    of = np.repeat(label, [len(t) for t in terms])
    has = np.stack([np.bincount(at[of == c], minlength=len(every)) for c in (0, 1)], 1).astype(float)
    without = sizes - has
    total = sizes.sum()
    g = np.zeros(len(every))
    for part in (has, without):
        expected = part.sum(1, keepdims=True) * sizes / total
        g += 2 * np.where(part > 0, part * np.log(np.maximum(part, 1e-9) / np.maximum(expected, 1e-9)), 0).sum(1)
    return every[g >= LEAST_G].astype(U64)


@dataclass
class Whole:
    """All terms of the examples: postings by term and weights by example."""

    vocabulary: np.ndarray  # sorted hashes
    idf: np.ndarray
    unseen: float  # idf of other terms
    begins: np.ndarray  # of each term's postings
    example: np.ndarray
    weight: np.ndarray
    most: np.ndarray
    bounds: np.ndarray  # of each example's terms
    term: np.ndarray
    own: np.ndarray
    curve: tuple[float, float] | None = None

    def vector(self, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, weight) of the hashes that examples have."""
        at = np.minimum(np.searchsorted(self.vocabulary, term), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == term
        x = (1 + np.log(count)) * np.where(known, self.idf[at], self.unseen)
        norm = np.sqrt((x * x).sum())
        return at[known], (x[known] / norm if norm else x[known])

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example, similarity) of the k nearest with a common term; ties go to the earlier example."""
        n = len(self.bounds) - 1
        size = self.begins[term + 1] - self.begins[term]
        order = np.argsort(size, kind="stable")
        term, weight, size = term[order], weight[order], size[order]
        left = np.append(np.cumsum((weight * self.most[term])[::-1])[::-1], 0.0)  # at most, from each term on
        cost = np.cumsum(size)
        sums, a, budget = np.zeros(n), 0, n
        while True:
            b = max(a + 1, int(np.searchsorted(cost, budget, side="right"))) if a < len(term) else a
            b = min(b, len(term))
            sz = size[a:b]
            entry = np.arange(int(sz.sum())) + np.repeat(self.begins[term[a:b]] - (np.cumsum(sz) - sz), sz)
            sums += np.bincount(self.example[entry], self.weight[entry] * np.repeat(weight[a:b], sz), n)
            if skip >= 0:
                sums[skip] = -1.0 - left[0]
            a, budget = b, 4 * budget
            least = np.partition(sums, n - k)[n - k] if n > k else 0.0
            near = np.flatnonzero((sums + left[a] >= max(least, 0.0) - 1e-6) & (sums + left[a] > 0))
            if a == len(term) or len(near) <= 8 * k:
                break
        if a < len(term) and len(near):  # the rest of those alone
            q = np.zeros(len(self.vocabulary))
            q[term] = weight
            sz = self.bounds[near + 1] - self.bounds[near]
            entry = np.arange(int(sz.sum())) + np.repeat(self.bounds[near] - (np.cumsum(sz) - sz), sz)
            got = np.bincount(np.repeat(np.arange(len(near)), sz), q[self.term[entry]] * self.own[entry], len(near))
        else:
            got = sums[near]
        near, got = near[got > 0], got[got > 0]
        keep = np.lexsort((near, -got))[:k]
        return near[keep], got[keep]


def whole(docs: list[tuple[np.ndarray, np.ndarray]], vocabulary: np.ndarray, df: np.ndarray, n_docs: int) -> Whole | None:
    """All terms of examples given as (hashes, counts)."""
    if not len(vocabulary):
        return None
    idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1e-3
    none = np.zeros(0)
    w = Whole(vocabulary, idf, float(np.log((1.0 + n_docs) / 2.0) + 1e-3), none, none, none, none, none, none, none)
    vectors = [w.vector(h, c) for h, c in docs]
    sizes = np.array([len(t) for t, _ in vectors])
    w.bounds = np.concatenate([[0], np.cumsum(sizes)])
    w.term = np.concatenate([t for t, _ in vectors]).astype(np.int32)
    w.own = np.concatenate([x for _, x in vectors]).astype(np.float32)
    order = np.argsort(w.term, kind="stable")
    w.example = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)[order]
    w.weight = w.own[order]
    w.begins = np.searchsorted(w.term[order], np.arange(len(vocabulary) + 1))
    w.most = np.maximum.reduceat(w.weight, w.begins[:-1])  # each term has an example
    return w


@dataclass
class Index:
    vocabulary: np.ndarray  # sorted hashes
    idf: np.ndarray
    most: np.ndarray  # [terms, blocks] greatest weights
    local: list[np.ndarray]  # of each block: place of a term in its postings, or -1
    postings: list[np.ndarray]  # of each block: [its terms, its examples]
    ids: np.ndarray
    label: np.ndarray
    prior: float
    blank: float  # of texts without terms
    curve: tuple[float, float]
    whole: Whole | None = None  # for texts without terms of the vocabulary

    def weights(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt((x * x).sum())
        return (x / norm if norm else x).astype(np.float32)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example, similarity) of the k nearest with a common term; ties go to the earlier example."""
        bound = weight @ self.most[term] * np.float32(1.00001)
        best_at, best = np.zeros(0, np.int64), np.zeros(0, np.float32)
        least = 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) >= k and bound[b] < least:
                break
            place = self.local[b][term]
            has = place >= 0
            got = weight[has] @ self.postings[b][place[has]]
            take = np.flatnonzero((got >= least) & (got > 0))
            at = take + b * BLOCK
            if skip >= 0:
                take, at = take[at != skip], at[at != skip]
            best_at, best = np.concatenate([best_at, at]), np.concatenate([best, got[take]])
            if len(best) > k:
                keep = np.lexsort((best_at, -best))[:k]
                best_at, best = best_at[keep], best[keep]
            if len(best) >= k:
                least = float(best.min())
        order = np.lexsort((best_at, -best))
        return best_at[order], best[order]

    def vote(self, at: np.ndarray, similarity: np.ndarray) -> float:
        w = similarity.astype(float) ** POWER
        return float((w * self.label[at]).sum() / (w.sum() + ABSENT)) if len(at) else -1.0

    def outside(self, term: np.ndarray, count: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """(score, examples, similarities) of a text without terms of the vocabulary, given by all its terms."""
        w = self.whole
        if w is None or w.curve is None or not len(term):
            return self.score(-1.0), np.zeros(0, np.int64), np.zeros(0)
        at, similarity = w.nearest(*w.vector(term, count), NEIGHBOURS, skip)
        return self.chance(self.vote(at, similarity), w.curve) if len(at) else self.score(-1.0), at, similarity

    def score(self, vote: float) -> float:
        if not 0 < self.prior < 1:
            return self.prior
        if vote < 0:
            return self.blank
        return self.chance(vote, self.curve)

    @staticmethod
    def chance(vote: float, curve: tuple[float, float]) -> float:
        a, b = curve
        return float(1 / (1 + np.exp(-np.clip(a * vote + b, -40, 40))))


def build(ids: np.ndarray, label: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], vocabulary: np.ndarray, df: np.ndarray, n_docs: int, totals: tuple[int, int]) -> Index:
    """The index of examples given as (hashes, counts)."""
    idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1e-3
    prior = totals[1] / sum(totals) if sum(totals) else 0.0
    index = Index(vocabulary, idf, np.zeros((len(vocabulary), 0), np.float32), [], [], ids, label, prior, prior, (1.0, 0.0))
    vectors = []
    for h, c in docs:
        at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
        known = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
        vectors.append((at[known], index.weights(at[known], c[known])))
    # like examples side by side: by class, then by their heaviest frequent term, a stand-in for language
    frequent = set(np.argsort(-df)[:64].tolist())
    lead = [max(((w, t) for t, w in zip(t_.tolist(), w_.tolist(), strict=True) if t in frequent), default=(0, -1))[1] for t_, w_ in vectors]
    order = np.lexsort((np.arange(len(label)), lead, label)) if len(label) else np.zeros(0, np.int64)
    index.ids, index.label = ids[order], label[order].astype(float)
    vectors = [vectors[i] for i in order]
    columns = []
    for start in range(0, len(vectors), BLOCK):
        part = vectors[start : start + BLOCK]
        terms = np.unique(np.concatenate([t for t, _ in part]))
        local = np.full(len(vocabulary), -1, np.int32)
        local[terms] = np.arange(len(terms))
        dense = np.zeros((len(terms), len(part)), np.float32)
        for j, (t, w) in enumerate(part):
            dense[local[t], j] = w
        most = np.zeros(len(vocabulary), np.float32)
        most[terms] = dense.max(1) if len(terms) else 0
        index.local.append(local)
        index.postings.append(dense)
        columns.append(most)
    if columns:
        index.most = np.stack(columns, 1)
    votes = np.array([index.vote(*index.nearest(t, w, NEIGHBOURS, skip=i)) for i, (t, w) in enumerate(vectors)])
    known = votes >= 0
    if 0 < prior < 1 and 0 < index.label.sum() < len(index.label):
        share = np.where(index.label == 1, prior / index.label.mean(), (1 - prior) / (1 - index.label.mean()))
        none = share[~known]
        index.blank = float(((none * index.label[~known]).sum() + prior) / (none.sum() + 1))
        index.curve = logistic(votes[known], index.label[known], share[known])
    return index


def add_whole(index: Index, docs: list[tuple[np.ndarray, np.ndarray]], vocabulary: np.ndarray, df: np.ndarray, n_docs: int) -> None:
    """The index of all terms, examples in the order of `index`. Its curve has the slope of all examples' votes and
    gives, over those without terms of the smaller vocabulary, `blank`."""
    index.whole = w = whole(docs, vocabulary, df, n_docs)
    if w is None or not 0 < index.prior < 1 or not 0 < index.label.sum() < len(index.label):
        return
    parts = [slice(w.bounds[i], w.bounds[i + 1]) for i in range(len(docs))]
    votes = np.array([max(0.0, index.vote(*w.nearest(w.term[x].astype(np.int64), w.own[x].astype(float), NEIGHBOURS, skip=i))) for i, x in enumerate(parts)])
    share = np.where(index.label == 1, index.prior / index.label.mean(), (1 - index.prior) / (1 - index.label.mean()))
    slope, at = logistic(votes, index.label, share)
    out = np.array([not np.isin(h, index.vocabulary).any() for h, _ in docs], bool)
    if out.any():
        low, high = -60.0 - abs(slope), 60.0 + abs(slope)
        for _ in range(60):
            at = (low + high) / 2
            p = 1 / (1 + np.exp(-np.clip(slope * votes[out] + at, -40, 40)))
            low, high = (at, high) if (share[out] * p).sum() < index.blank * share[out].sum() else (low, at)
    if slope > 0:
        w.curve = (slope, at)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Weighted logistic regression of one variable by Newton steps."""
    a = b = 0.0
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        grad = design.T @ (weight * (y - p)) - ridge * np.array([a, b])
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = words.text_buffers(batch.column("text"))
        row, term, count = term_counts(data, offsets)
        bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
        cut = lambda x, t: pa.array([x[a:b].astype(t).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), cut(term, "<u8"), cut(count, "<i4")], ["doc_id", "terms", "counts"])


def _document_frequency(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            data, offsets = words.text_buffers(batch.column("text"))
            n += batch.num_rows
            for a, b in words.slices(offsets):
                term = term_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], vocabulary)[1]
                df += np.bincount(term, minlength=len(vocabulary))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["term", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Index:
    """Index and curve from `labels` (doc_id, toxic 0 or 1): at most `per_class` examples of each class are used."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for c in (0, 1):
        part = known.filter(F.col("toxic") == c).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    rows = chosen.collect()  # twice per_class rows at most
    picked = F.broadcast(spark.createDataFrame(rows, chosen.schema))
    # the texts of the sample, as term counts
    got = docs.select("doc_id", "text").join(picked.select("doc_id"), "doc_id", "left_semi").mapInArrow(_terms, "doc_id string, terms binary, counts binary").collect()
    label = {str(r["doc_id"]): r["toxic"] for r in rows}
    examples: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], bytes(r["terms"]))):
        examples.setdefault(r["doc_id"], (np.frombuffer(r["terms"], "<u8"), np.frombuffer(r["counts"], "<i4")))
    ids = np.array(sorted(examples), object)
    classes = np.array([label[i] for i in ids], np.int64)
    texts = [examples[i] for i in ids]
    every = np.unique(np.concatenate([np.zeros(0, U64), *[h for h, _ in texts]]))
    df, n_docs = np.zeros(len(every), np.int64), 0
    got = docs.select("text").mapInArrow(_document_frequency(every), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # the sample's terms at most
    term, n = got["term"].to_numpy(), got["n"].to_numpy()
    df[term[term >= 0]] = n[term >= 0]
    n_docs = int(n[term < 0].sum())
    vocabulary = select([h for h, _ in texts], classes)
    index = build(ids, classes, texts, vocabulary, df[np.searchsorted(every, vocabulary)], n_docs, (counts.get(0, 0), counts.get(1, 0)))
    add_whole(index, [examples[i] for i in index.ids], every, df, n_docs)
    return index


EVIDENCE = "array<struct<example:string,toxic:int,similarity:float>>"


def score(docs: DataFrame, index: Index, keep: tuple[str, ...] = ("doc_id",), evidence: bool = True, names: tuple[str, str] = ("score", "evidence"), own: str | None = None) -> DataFrame:
    """Columns `keep` of every row of `docs` (text), its score in [0, 1] and its nearest examples, called `names`, which must not be in `keep`.

    `own` names the column of ids: a row that is an example is not its own neighbour, so its label is no input of its score.
    """
    if clash := set(map(str.lower, names)) & set(map(str.lower, keep)):
        raise ValueError(f"columns {sorted(clash)} are there already: give other names")
    spark = docs.sparkSession
    shared.small_batches(spark)
    sent = spark.sparkContext.broadcast(index)  # bounded by the sample
    evidence_type = pa.list_(pa.struct([("example", pa.string()), ("toxic", pa.int32()), ("similarity", pa.float32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        place = {x: i for i, x in enumerate(index.ids.tolist())} if own else {}
        for batch in batches:
            skips = [place.get(x, -1) for x in batch.column(own).cast(pa.string()).to_pylist()] if own else [-1] * batch.num_rows
            data, offsets = words.text_buffers(batch.column("text"))
            scores, shown = [], []
            for a, b in words.slices(offsets):
                row, term, count = term_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], index.vocabulary)
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                outside = np.flatnonzero(bounds[:-1] == bounds[1:])
                texts = [data[offsets[a + i] : offsets[a + i + 1]] for i in outside]
                row_o, term_o, count_o = term_counts(np.concatenate([data[:0], *texts]), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]))
                bounds_o = dict(zip(outside.tolist(), np.searchsorted(row_o, [np.arange(len(outside)), np.arange(1, len(outside) + 1)]).T.tolist(), strict=True))
                for i in range(b - a):
                    if i in bounds_o:
                        part = slice(*bounds_o[i])
                        value, at, similarity = index.outside(term_o[part], count_o[part], skips[a + i])
                        scores.append(value)
                        shown.append([{"example": index.ids[x], "toxic": int(index.label[x]), "similarity": float(s)} for x, s in zip(at, similarity, strict=True)] if evidence else [])
                        continue
                    part = slice(bounds[i], bounds[i + 1])
                    at, similarity = index.nearest(term[part], index.weights(term[part], count[part]), NEIGHBOURS, skips[a + i]) if bounds[i] < bounds[i + 1] and index.local else (np.zeros(0, np.int64), np.zeros(0))
                    scores.append(index.score(index.vote(at, similarity)))
                    shown.append([{"example": index.ids[x], "toxic": int(index.label[x]), "similarity": float(s)} for x, s in zip(at, similarity, strict=True)] if evidence else [])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(scores, pa.float64()), pa.array(shown, evidence_type)], [*keep, *names])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    taken = docs.select(*dict.fromkeys((*keep, "text", *([own] if own else []))))
    out = taken.mapInArrow(run, f"{fields}, {names[0]} double, {names[1]} {EVIDENCE}")
    return out if evidence else out.drop(names[1])
