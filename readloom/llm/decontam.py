"""Benchmark decontamination by a distributed positional inverted index.

1. The benchmark's words get term numbers; its windows (runs of `width` words, or a
   whole shorter item) become lists of terms.
2. Each batch of documents is a shard of the index: postings (document, position) of
   benchmark terms, stored as a table, document by document, together with how often
   each term occurs; the counts are summed over all shards.
3. A window is looked up from its rarest terms over the whole corpus: the postings of
   a term, shifted by its offset in the window, are intersected with the other terms'
   lists shifted by theirs, and what is left are exact phrase matches. Starts where at
   least `near` of the terms stand at their places are proximity matches; as any of them
   holds one of the window's (size - near + 1) rarest, those are looked up.

Windows are matched in blocks of about `MAX_WINDOWS`, dealt by their words so that equal windows of
several items stay one; each block is held against the stored postings and adds its matches to those
of the blocks before. A block and the benchmark's distinct words alone are sent to all executors.

Defined cases: null text has no words; repeated rows count each; an empty benchmark hits nothing; documents
without words have n_words 0 and are clean; texts of any length are read whole, so many documents at once that
their words take a bounded table; ties of rarity go to the earlier place in the window; other columns are carried
by `drop_leaks`, whatever their names, and not read by `find_benchmark`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm import shared, words

WIDTH = 13
#: Proven bound of what is broadcast at once: a benchmark of more windows is matched in blocks.
MAX_WINDOWS = 2_000_000


@dataclass
class Queries:
    """Windows as rows of term numbers (-1 beyond the end of a short one)."""

    vocabulary: np.ndarray  # sorted hashes; a term's number is its place
    terms: np.ndarray  # [windows, width]
    size: np.ndarray  # words of each window
    begins: np.ndarray  # where the owners of each window begin
    owner: np.ndarray  # places in `items`
    items: list[str]  # ids

    def owners(self, window: int) -> list[str]:
        """Ids of the items that hold a window."""
        return [self.items[k] for k in self.owner[self.begins[window] : self.begins[window + 1]].tolist()]


Items = list[tuple[object, str | None]]


def item_lists(benchmark: DataFrame, size: int = 2000) -> Iterator[Items]:
    """The rows of `benchmark`, so many at once."""
    rows = (tuple(r) for r in benchmark.select("item_id", "text").toLocalIterator())
    while part := list(islice(rows, size)):
        yield part


def _split(items: Items) -> words.Words:
    data, offsets = words.text_buffers(pa.array([t for _, t in items], pa.string()))
    return words.split(data, offsets, words.ALNUM, lower=True)


def count_windows(lists: Iterable[Items], width: int = WIDTH) -> tuple[np.ndarray, int]:
    """Sorted hashes of all words, and the number of windows, equal ones counted each."""
    vocabulary, n = np.zeros(0, words.U64), 0
    for items in lists:
        w = _split(items)
        vocabulary = np.union1d(vocabulary, w.hash)
        counts = w.counts()
        n += int(np.maximum(counts - width + 1, counts > 0).sum())
    return vocabulary, n


def compile_queries(lists: Iterable[Items], vocabulary: np.ndarray, width: int = WIDTH, block: int = 0, blocks: int = 1) -> Queries:
    """The distinct windows of one block of `blocks`, which the words of a window decide."""
    terms, owner, names = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int32)], []
    for items in lists:
        w = _split(items)
        term = np.concatenate([np.searchsorted(vocabulary, w.hash), np.full(width, -1)]).astype(np.int32)
        counts = w.counts()
        n = np.maximum(counts - width + 1, counts > 0)
        n[[i for i, (item_id, _) in enumerate(items) if item_id is None]] = 0
        item = np.repeat(np.arange(len(items)), n)
        first = np.cumsum(counts) - counts
        start = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        at = start[:, None] + np.arange(width)
        rows = np.where(at < (first + counts)[item][:, None], term[np.minimum(at, len(term) - 1)], -1).astype(np.int32)
        if blocks > 1:
            h = np.zeros(len(rows), words.U64)
            for j in range(width):
                h = words.mix(h + rows[:, j].astype(np.int64).astype(words.U64) + words.U64(1))
            mine = h % words.U64(blocks) == words.U64(block)
            rows, item = rows[mine], item[mine]
        terms.append(rows)
        owner.append((len(names) + item).astype(np.int32))
        names += ["" if item_id is None else str(item_id) for item_id, _ in items]
    every, own = np.concatenate(terms), np.concatenate(owner)
    order = np.lexsort((own, *every.T[::-1]))
    every, own = every[order], own[order]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:] != every[:-1]).any(1)
    once = new.copy()  # an item that holds a window twice counts once
    once[1:] |= own[1:] != own[:-1]
    distinct, group = every[new], np.cumsum(new) - 1
    return Queries(vocabulary, distinct, (distinct >= 0).sum(1).astype(np.int32), np.searchsorted(group[once], np.arange(len(distinct) + 1)), own[once], names)


def _index(vocabulary: np.ndarray, id_name: str):
    """Documents to their postings: positions of benchmark terms and the terms there, in order of position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.text_buffers(batch.column("text"))
            n_words, terms, places = [], [], []
            for a, b in words.slices(offsets):
                w = words.split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words.ALNUM, lower=True)
                counts = w.counts()
                position = np.arange(len(w.row)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = np.minimum(np.searchsorted(vocabulary, w.hash), max(len(vocabulary) - 1, 0))
                known = np.flatnonzero(vocabulary[at] == w.hash) if len(vocabulary) else np.zeros(0, np.int64)
                bounds = np.searchsorted(w.row[known], np.arange(b - a + 1))
                t, p = at[known].astype("<i4"), position[known].astype("<i4")
                n_words.extend(counts.tolist())
                for i in range(b - a):
                    terms.append(t[bounds[i] : bounds[i + 1]].tobytes())
                    places.append(p[bounds[i] : bounds[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(id_name), pa.array(n_words, pa.int64()), pa.array(terms, pa.binary()), pa.array(places, pa.binary())], [id_name, "n_words", "terms", "places"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        t = np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4")
        if len(t):
            n = np.bincount(t)
            total = np.pad(total, (0, max(0, len(n) - len(total))))
            total[: len(n)] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "n"])


@dataclass
class Lookup:
    """Which windows a term looks up, and at what offset in them: entries in order of the term; where each term's begin."""

    window: np.ndarray
    offset: np.ndarray
    begins: np.ndarray


def lookups(q: Queries, rarity: np.ndarray, near: int) -> Lookup:
    """The rarest terms of each window; ties go to the earlier place."""
    cost = np.where(q.terms >= 0, rarity[np.maximum(q.terms, 0)] if len(rarity) else 0, np.iinfo(np.int64).max)
    rank = np.argsort(cost, 1, kind="stable")
    used = np.maximum(q.size - near, 0) + 1
    window, nth = np.nonzero(np.arange(q.terms.shape[1]) < used[:, None])
    offset = rank[window, nth]
    term = q.terms[window, offset]
    order = np.argsort(term, kind="stable")
    return Lookup(window[order], offset[order], np.searchsorted(term[order], np.arange(len(q.vocabulary) + 1)))


def intersect(doc: np.ndarray, place: np.ndarray, term: np.ndarray, n_words: np.ndarray, q: Queries, look: Lookup, near: int) -> tuple[np.ndarray, ...]:
    """(doc, start, window, matched) of every window with at least min(near, size) terms at their places.

    `doc`, `place`, `term` are a shard's postings in order of document and place.
    """
    n = look.begins[term + 1] - look.begins[term]  # windows that a posting looks up
    hit = np.flatnonzero(n)
    post = np.repeat(hit, n[hit])
    if not len(post):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    first = np.cumsum(n[hit]) - n[hit]
    entry = np.arange(len(post)) - np.repeat(first, n[hit]) + np.repeat(look.begins[term[hit]], n[hit])
    window, start = look.window[entry], place[post] - look.offset[entry]
    fits = (start >= 0) & (start + q.size[window] <= n_words[doc[post]])
    post, window, start = post[fits], window[fits], start[fits]
    base = np.concatenate([[0], np.cumsum(n_words)])
    slot = np.full(int(base[-1]) + 1, -2, np.int32)  # the shard's lists laid out by place
    slot[base[doc] + place] = term
    at = base[doc[post]] + start
    need = np.minimum(near, q.size)[window]
    missed = np.zeros(len(post), np.int32)
    live = np.arange(len(post))
    for j in range(q.terms.shape[1]):
        t = q.terms[window[live], j]
        missed[live] += (t >= 0) & (slot[np.minimum(at[live] + j, len(slot) - 1)] != t)
        live = live[q.size[window[live]] - missed[live] >= need[live]]
    # one that several of its terms looked up counts once
    order = np.lexsort((at[live], window[live]))
    live = live[order]
    once = np.concatenate([[True], (window[live][1:] != window[live][:-1]) | (at[live][1:] != at[live][:-1])]) if len(live) else np.zeros(0, bool)
    live = live[once]
    return doc[post[live]], start[live], window[live], q.size[window[live]] - missed[live]


#: What a block adds to, beside the postings.
FOUND = "n_near long, items array<string>, spans array<struct<start:int,end:int>>"


def _match(q: Queries, rarity: np.ndarray, near: int, id_name: str, keep_postings: bool = False):
    """Matches of a block, added to those that the rows have from blocks before; postings stay for a next one."""
    look = lookups(q, rarity, near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.array(batch.column("n_words"), np.int64)
            raw_t, raw_p = batch.column("terms").to_pylist(), batch.column("places").to_pylist()
            sizes = np.array([len(t) // 4 for t in raw_t], np.int64)
            out = {k: [] for k in ("n_hit", "n_near", "items", "spans")}
            a = 0
            while a < len(sizes):  # so many documents that their words take a bounded table
                b = a + max(1, int(np.searchsorted(np.cumsum(n_words[a:]), 4_000_000)))
                own = n_words[a:b]
                doc = np.repeat(np.arange(len(own)), sizes[a:b])
                d, s, w, m = intersect(doc, np.frombuffer(b"".join(raw_p[a:b]), "<i4").astype(np.int64), np.frombuffer(b"".join(raw_t[a:b]), "<i4").astype(np.int64), own, q, look, near)
                exact = m == q.size[w]
                base = np.concatenate([[0], np.cumsum(own)])
                items, spans, n_near = [set() for _ in own], [set() for _ in own], np.bincount(d[~exact], minlength=len(own))
                mark = np.zeros(int(base[-1]) + 1, np.int32)
                if "spans" in batch.schema.names:
                    before = batch.slice(a, len(own))
                    n_near = n_near + np.array(before.column("n_near"), np.int64)
                    for i, (x, sp) in enumerate(zip(before.column("items").to_pylist(), before.column("spans").to_pylist(), strict=True)):
                        items[i].update(x)
                        for r in sp:
                            spans[i].add((r["start"], r["end"]))
                            mark[base[i] + r["start"]] += 1
                            mark[base[i] + r["end"]] -= 1
                np.add.at(mark, base[d[exact]] + s[exact], 1)
                np.add.at(mark, base[d[exact]] + s[exact] + q.size[w[exact]], -1)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
                out["n_hit"].extend((covered[base[1:]] - covered[base[:-1]]).tolist())
                out["n_near"].extend(n_near.tolist())
                for i, st, win in zip(d[exact].tolist(), s[exact].tolist(), w[exact].tolist(), strict=True):
                    items[i].update(q.owners(win))
                    spans[i].add((st, st + int(q.size[win])))
                out["items"].extend(sorted(x) for x in items)
                out["spans"].extend([{"start": x, "end": y} for x, y in sorted(sp)] for sp in spans)
                a = b
            found = [pa.array(out["n_near"], pa.int64()), pa.array(out["items"], pa.list_(pa.string())), pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            first = ("terms", "places") if keep_postings else ("n_hit",)
            own = [batch.column(c) for c in first] if keep_postings else [pa.array(out["n_hit"], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(id_name), batch.column("n_words"), *own, *found], [id_name, "n_words", *first, "n_near", "items", "spans"])

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, near: int | None = None, id_name: str = "doc_id") -> DataFrame:
    """Per row of `docs` (id, text): id, n_words, n_hit (words inside exact matches), n_near (proximity
    matches), items (item ids with exact matches), spans (word ranges of the matches)."""
    spark = docs.sparkSession
    shared.small_batches(spark, 2000)
    near = near if near is not None else width - 2
    vocabulary, n = count_windows(item_lists(benchmark), width)
    blocks = max(1, -(-n // MAX_WINDOWS))
    kind = docs.schema[id_name].dataType.simpleString()
    index = shared.materialize(docs.select(id_name, "text").mapInArrow(_index(vocabulary, id_name), f"{id_name} {kind}, n_words long, terms binary, places binary"), "postings")
    rarity = np.zeros(len(vocabulary), np.int64)
    for r in index.select("terms").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # benchmark words at most
        rarity[r["term"]] = r["n"]
    for block in range(blocks - 1):
        q = compile_queries(item_lists(benchmark), vocabulary, width, block, blocks)
        index = shared.materialize(index.mapInArrow(_match(q, rarity, near, id_name, True), f"{id_name} {kind}, n_words long, terms binary, places binary, {FOUND}"), "postings")
    q = compile_queries(item_lists(benchmark), vocabulary, width, blocks - 1, blocks)
    return index.mapInArrow(_match(q, rarity, near, id_name), f"{id_name} {kind}, n_words long, n_hit long, {FOUND}")


def digest(found: DataFrame) -> DataFrame:
    """n_items, items_sha256 and contaminated from find_benchmark()'s columns."""
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), contaminated().alias("contaminated"), "n_near", listed.alias("spans"))


def contaminated() -> Column:
    """The rule of the report: hits in at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def leaked(width: int = WIDTH) -> Column:
    """The rule of the filter: a whole window anywhere, or shorter items in at least a twentieth of the words."""
    return F.exists("spans", lambda s: s["end"] - s["start"] >= width) | contaminated()


def drop_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of `docs` whose text is not `leaked()`, with all their columns. Texts are told by their SHA-256, so the decision
    needs no row numbers and is the same for equal texts."""
    key = shared.free_name(docs, "text_key")
    named = docs.withColumn(key, F.sha2(shared.text_of(), 256))
    found = find_benchmark(named, benchmark, width, id_name=key)
    return named.join(found.filter(leaked(width)).select(key).distinct(), key, "left_anti").select(*docs.columns)
