"""Near-duplicate classes by BagMinHash, banding and verified multiset overlap.

A text is the multiset of its runs of five words (a shorter text with words is one run).
Two texts are linked if their weighted Jaccard similarity, the sum of the smaller over
the sum of the larger counts, is at least 0.8; classes are connected by links.

1. Signatures: each (run, level) is a Poisson process over time and weight. The weight
   axis is cut into the levels [0,1), [1,2), [2,4), [4,8), ...; a level that a count
   fills only in part is thinned by the points' place in it. Each point falls on one of
   192 registers, and a register keeps its earliest point, so two texts agree in a
   register with probability equal to their similarity. A process stops as soon as its
   time passes the latest register, which bounds the points to about n + m ln m.
2. 32 bands of 6 registers: a linked pair meets in a band with probability over 0.9999
   at 0.8 and more beyond.
3. Members of a band's bucket are verified against the bucket's densest member, the one
   that meets most texts over all bands. Verified pairs are links and connect classes.
4. Exact rest: where a bucket still holds texts of several classes, every text outside the
   bucket's largest class is held against all its members of other classes, in blocks of
   bounded size. A byte of each of the 192 registers prunes pairs in the block: a linked
   pair agrees in 154 on average and is lost below 126, five standard deviations down.
   What remains and was not tested before is verified. No bucket is capped.

Defined cases: null text is empty; a text without words is a class of its own; equal
texts are one class; null ids are kept, and class_id is the smallest id that is not
null; very long texts are read whole; a similarity of exactly 0.8 is a link; an empty table
gives an empty result; `keep_one` carries other columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm import shared, words
from readloom.llm.words import U64, mix, runs

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
#: Least equal bytes of two sketches, and members in a block of a bucket on average.
AGREE, BLOCK = 126, 1024
_STEP, _LEVEL, _ROW = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3)


def multiset(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct hashes of each row."""
    key = mix(h + (row.astype(U64) + U64(1)) * _ROW)
    order = np.argsort(key)
    first, count = runs(key[order])
    at = order[first]
    return row[at], h[at], count


def signatures(row: np.ndarray, h: np.ndarray, count: np.ndarray, rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash registers, float32 [rows, m]; rows without elements stay infinite."""
    reg = np.full(rows * m, np.inf)
    level = np.zeros(len(count), np.int64)
    items = [np.arange(len(count))]
    levels = [level]
    k = 1
    while len(more := np.flatnonzero(count > (1 << (k - 1)))):
        items.append(more)
        levels.append(np.full(len(more), k))
        k += 1
    at, level = np.concatenate(items), np.concatenate(levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    span = np.maximum(low, 1).astype(np.float64)
    own, weight = row[at], count[at]
    seed = mix(h[at] + level.astype(U64) * _LEVEL)
    time = np.zeros(len(at))
    latest = np.full(rows, np.inf)
    j = 0
    while len(at):
        j += 1
        draw = mix(seed + U64(j * int(_STEP) % (1 << 64)))
        time = time - np.log(((draw >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / span
        live = time < latest[own]
        if not live.all():
            own, seed, time, low, span, weight, at, draw = (x[live] for x in (own, seed, time, low, span, weight, at, draw))
        point = mix(draw ^ _LEVEL)
        slot = ((point >> U64(32)) * U64(m)) >> U64(32)
        inside = low + span * ((point & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < weight
        np.minimum.at(reg, own[inside] * m + slot[inside].astype(np.int64), time[inside])
        latest = reg.reshape(rows, m).max(1)
    return reg.reshape(rows, m).astype(np.float32)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    part = sig.view(np.uint32).reshape(len(sig), bands, sig.shape[1] // bands).astype(U64)
    key = np.broadcast_to(np.arange(bands, dtype=U64) * _LEVEL, part.shape[:2])
    for j in range(part.shape[2]):
        key = mix(key + part[:, :, j] * _STEP)
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = words.text_buffers(batch.column("text"))
        for a, b in words.slices(offsets):
            w = words.split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words.NOT_SPACE, lower=False)
            row, h, count = multiset(*words.shingles(w, WIDTH))
            some = np.flatnonzero(np.bincount(row, minlength=b - a))
            sig = signatures(row, h, count, b - a)[some]
            keys = band_keys(sig)
            sketch = (mix(sig.view(np.uint32).astype(U64)) >> U64(56)).astype(np.uint8)
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("tid").slice(a, b - a).take(pa.array(some)), column, pa.array([x.tobytes() for x in sketch], pa.binary())], ["tid", "keys", "sketch"])


def _by_block(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple], list[tuple]]]:
    """(block, left rows, right rows) from rows sorted by block (key, i, j)."""
    block, sides = None, ([], [])
    for batch in batches:
        c = [batch.column(name).to_pylist() for name in ("key", "i", "j", "left", *fields)]
        for key, i, j, left, *rest in zip(*c, strict=True):
            if (key, i, j) != block:
                if sides[0] and sides[1]:
                    yield block, *sides
                block, sides = (key, i, j), ([], [])
            sides[0 if left else 1].append(tuple(rest))
    if sides[0] and sides[1]:
        yield block, *sides


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, the members with a partner across components whose sketch allows a link; a pair counts
    in the first bucket that it shares."""
    out: list[tuple] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["key", "i", "j", "left", "tid"])
    for block, left, right in _by_block(batches, ("tid", "comp", "sketch", "keys")):
        sketches = np.frombuffer(b"".join(x[2] for x in right), np.uint8).reshape(len(right), -1)
        keys, comps = np.array([x[3] for x in right]), np.array([x[1] for x in right], object)
        found = np.zeros(len(right), bool)
        for tid, comp, sketch, own in left:
            near = np.flatnonzero((sketches == np.frombuffer(sketch, np.uint8)).sum(1) >= AGREE)
            if len(near):
                same = keys[near] == np.array(own)
                near = near[(comps[near] != comp) & (np.array(own)[same.argmax(1)] == block[0])]
            if len(near):
                found[near] = True
                out.append((*block, True, tid))
        out.extend((*block, False, right[k][0]) for k in np.flatnonzero(found))
        if len(out) > 20_000:
            yield flush()
            out.clear()
    yield flush()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the left and right members of each block, by exact overlap."""
    for _, left, right in _by_block(batches, ("tid", "comp", "text")):
        w = words.split(*words.text_buffers(pa.array([x[2] for x in (*left, *right)])), words.NOT_SPACE, lower=False)
        row, h, count = multiset(*words.shingles(w, WIDTH))
        # an element for each time a run occurs makes the sum of smaller counts an intersection
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        row, element = np.repeat(row, count), np.repeat(h, count) + nth.astype(U64) * _STEP
        order = np.argsort(row, kind="stable")
        bounds = np.searchsorted(row[order], np.arange(w.rows + 1))
        column = np.unique(element[order], return_inverse=True)[1]
        size, start = np.diff(bounds), bounds[len(left)]
        mark = np.zeros(column.max(initial=0) + 1, bool)
        comps = np.array([x[1] for x in right], object)
        for k, (tid, comp, _) in enumerate(left):
            own = column[bounds[k] : bounds[k + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[column[start:]].astype(np.int64), bounds[len(left) : -1] - start)
            mark[own] = False
            similarity = both / np.maximum(size[k] + size[len(left) :] - both, 1)
            at = np.flatnonzero((similarity >= THRESHOLD) & (comps != comp))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([tid] * len(at), pa.binary()), pa.array([right[x][0] for x in at], pa.binary())], ["a", "b"])


def _rest(state: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components within the buckets of `state` (key, tid, comp)."""
    shares = state.groupBy("key", "comp").agg(F.count("*").alias("k"))
    buckets = shares.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("n"), F.count("*").alias("comps")).filter("comps > 1")
    buckets = buckets.select("key", F.col("top.comp").alias("top"), F.ceil(F.col("n") / BLOCK).alias("n_right"), F.ceil((F.col("n") - F.col("top.k")) / BLOCK).alias("n_left"))
    rows = shared.materialize(state.join(buckets, "key").join(signed, "tid"), "open")
    place = lambda n: F.pmod(F.xxhash64("tid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    what = ("tid", "comp", "sketch", "keys")
    left = rows.filter("comp <> top").select("key", place("n_left").alias("i"), every("n_right").alias("j"), F.lit(True).alias("left"), *what)
    right = rows.select("key", every("n_left").alias("i"), place("n_right").alias("j"), F.lit(False).alias("left"), *what)
    dealt = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    members = shared.materialize(dealt(left.unionByName(right)).mapInArrow(_possible, "key long, i long, j long, left boolean, tid binary"), "members")
    comps = state.select("tid", "comp").distinct()
    return dealt(members.join(comps, "tid").join(texts, "tid")).mapInArrow(_links, "a binary, b binary")


def overlap(data_a, off_a, data_b, off_b) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    n = len(off_a) - 1
    row, h, side = [], [], []
    for s, (data, off) in enumerate(((data_a, off_a), (data_b, off_b))):
        r, x = words.shingles(words.split(data, off, words.NOT_SPACE, lower=False), WIDTH)
        row.append(r)
        h.append(x)
        side.append(np.full(len(r), s, np.int64))
    row, h, side = map(np.concatenate, (row, h, side))
    key = mix(h + (row.astype(U64) + U64(1)) * _ROW)
    order = np.argsort(key)
    first, size = runs(key[order])
    if not len(first):
        return np.zeros(n)
    b = np.add.reduceat(side[order], first)
    own = row[order[first]]
    less, more = (np.bincount(own, f(b, size - b), n) for f in (np.minimum, np.maximum))
    return less / np.maximum(more, 1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (da, oa), (db, ob) = (words.text_buffers(batch.column(c)) for c in ("text_a", "text_b"))
        for a, b in words.slices(oa + ob):
            j = overlap(da[oa[a] : oa[b]], oa[a : b + 1] - oa[a], db[ob[a] : ob[b]], ob[a : b + 1] - ob[a])
            yield pa.RecordBatch.from_arrays([batch.column("a").slice(a, b - a), batch.column("b").slice(a, b - a), pa.array(j)], ["a", "b", "similarity"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among `pairs` (a, b)."""
    both = pairs.join(texts.select(F.col("tid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("tid").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a binary, b binary, similarity double").filter(F.col("similarity") >= THRESHOLD)


def components(edges: DataFrame) -> DataFrame:
    """(tid, comp) of every end of `edges` (a, b); comp is the smallest end of its component.

    Large-star and small-star steps by turns, each a grouped minimum and a join back, until nothing changes.
    """
    spark = edges.sparkSession
    pair = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, mark = shared.materialize(pair(edges), "edges"), None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark:
            break
        mark = seen
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = pair(large.union(least.filter("m < a").select("a", F.col("m").alias("b"))))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, shared.materialize(pair(small.union(least.select("a", F.col("m").alias("b")))), "edges")
        shared.drop(before)
    roots = now.select(F.col("b").alias("tid"), F.col("b").alias("comp")).distinct()
    return now.select(F.col("a").alias("tid"), F.col("b").alias("comp")).union(roots) if seen["n"] else spark.createDataFrame([], "tid binary, comp binary")


def text_id() -> Column:
    return F.unhex(F.md5(shared.text_of()))


def text_classes(docs: DataFrame) -> DataFrame:
    """(tid, comp) of every distinct text that is linked to a different one."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    base = docs.select(text_id().alias("tid"), shared.text_of().alias("text"))
    signed = shared.materialize(base.mapInArrow(_sign, "tid binary, keys array<long>, sketch binary").dropDuplicates(["tid"]), "signatures")
    bands = signed.select("tid", F.explode("keys").alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = shared.materialize(bands.join(sizes, "key"), "met")
    dense = met.groupBy("tid").agg(F.sum("n").alias("dense"))
    best = met.join(dense, "tid").groupBy("key").agg(F.max(F.struct("dense", "tid")).alias("best")).select("key", F.col("best.tid").alias("b"))
    first = shared.materialize(met.join(best, "key").filter("tid <> b").select(F.col("tid").alias("a"), "b").distinct(), "pairs")
    texts = shared.materialize(base.dropDuplicates(["tid"]).join(dense.select("tid"), "tid", "left_semi"), "texts")
    links = shared.materialize(_verified(first, texts), "links")
    comp = shared.materialize(components(links.select("a", "b")), "components")

    state = met.join(comp, "tid", "left").select("key", "tid", F.coalesce("comp", "tid").alias("comp"))
    more = shared.materialize(_rest(state, signed, texts), "links")
    out = components(links.select("a", "b").union(more.select("a", "b"))) if more.take(1) else comp
    shared.drop(signed, met, first, texts, links, more)
    return out


def _keyed(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """(doc_id, row_key, class_key) of `rows` (doc_id, row_key, tid, worded), which are numbered in a written table."""
    # a text without words is alone: its key is its row's
    own = F.when(F.col("worded"), F.coalesce("comp", "tid")).otherwise(F.col("row_key").cast("string").cast("binary"))
    return rows.join(comp, "tid", "left").select("doc_id", "row_key", own.alias("class_key"))


def _identities(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select("doc_id", text_id().alias("tid"), shared.text_of().rlike(r"[^\x20\x09-\x0D]").alias("worded"), *more)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest id of the class) and class_size of every row.

    The classes are written before rows are joined to them, so both sides of the join are plain shuffles, of which
    Spark splits the partitions of large classes.
    """
    rows, _ = shared.numbered(_identities(docs), "rows")
    keyed = _keyed(rows, text_classes(docs))
    found = shared.materialize(keyed.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    return keyed.join(found, "class_key").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns: the one with the smallest id, null ids last, of equal ids any one.

    The rows are numbered in a written table, so lost executors cannot renumber them between the choice and the join.
    """
    rows, key = shared.numbered(docs, "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    named = _identities(rows, F.col(key).alias("row_key"))
    kept = _keyed(named, text_classes(rows)).groupBy("class_key").agg(first.alias("k")).select(F.col("k.row_key").alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)
