"""Mixing, toxicity and language model scoring."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose

from readloom.llm import lm, mixing, toxicity, words

# Mixing


def mixed(spark, rng):
    rows = [(i, (". ".join(prose(rng, 12).capitalize() for _ in range(rng.randrange(2, 9)))) if i % 4 else "\n".join(["### %% | 99 12 |"] * rng.randrange(2, 30))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, str(int(i % 4 != 0))) for i in range(0, 400, 3)], "doc_id bigint, domain string")
    return rows, docs, labels


def test_rates_meet_the_targets(spark, rng):
    rows, docs, labels = mixed(spark, rng)
    targets = {"1": 0.5, "0": 0.5}
    m, members = mixing.fit(docs, labels, targets)
    out = mixing.rates(members, m).collect()
    n = np.array([r.n_tokens for r in out], float)
    assert sorted(n.tolist()) == sorted(len(t.split()) for _, t in rows)
    p = np.array([[r.p_1, r.p_0] for r in out])
    rate = np.array([r.rate for r in out])
    assert (rate >= 0).all() and np.allclose(p.sum(1), 1)
    assert np.allclose((rate * n) @ p, n.sum() / 2, rtol=1e-4)
    truth = np.array([r.doc_id % 4 != 0 for r in out])
    assert ((p[:, 0] > 0.5) == truth).mean() > 0.95
    # plain projected gradient on all documents comes to the same totals
    r2 = np.ones(len(n))
    for _ in range(4000):
        r2 = np.maximum(0, r2 - p @ ((r2 * n) @ p - n.sum() / 2) / n.sum())
    assert np.allclose((r2 * n) @ p, (rate * n) @ p, rtol=1e-3)


def test_unreachable_targets_are_least_squares(spark, rng):
    _, docs, labels = mixed(spark, rng)
    m, members = mixing.fit(docs, labels, {"1": 1.0, "0": 0.0})
    out = mixing.rates(members, m).collect()
    assert min(r.rate for r in out) >= 0
    n, p, rate = (np.array([f(r) for r in out]) for f in (lambda r: r.n_tokens, lambda r: (r.p_1, r.p_0), lambda r: r.rate))
    # the optimum of all document rates, by many plain steps
    goal, r, most = np.array([n.sum(), 0.0]), np.ones(len(n)), (p.T @ n).max()
    loss = lambda x: (((x * n) @ p - goal) ** 2).sum()
    for _ in range(20_000):
        r = np.maximum(0, r - p @ ((r * n) @ p - goal) / most)
    assert loss(rate) <= 1.001 * loss(r) + 1e-8 * n.sum() ** 2


def test_posteriors_are_naive_bayes(spark, rng):
    rows, docs, labels = mixed(spark, rng)
    m, members = mixing.fit(docs, labels, {"1": 0.5, "0": 0.5})

    def bins(t):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, chars, ls = len(ws), len(t), t.split("\n")
        rate = lambda pattern: len(re.findall(pattern, t)) / max(chars, 1)
        value = {"tokens": n, "word_length": (chars - n) / max(n, 1), "symbols": rate(r"[#*$%&|<>]"), "digits": rate("[0-9]"), "capitals": rate("[A-Z]"), "stops": rate(r"[.!?]"), "repeats": 1 - len(set(ls)) / len(ls)}
        return [sum(value[f] > b for b in bounds) for f, bounds in mixing.BINS.items()]

    of = {i: bins(t) for i, t in rows}
    known = {r.doc_id: r.domain for r in labels.collect()}
    logs = {}
    for i, own in of.items():
        total = []
        for d in ("1", "0"):
            mine = [of[k] for k, x in known.items() if x == d]
            total.append(math.log((len(mine) + 1) / (len(known) + 2)) + sum(math.log((sum(b[f] == v for b in mine) + 1) / (len(mine) + len(bounds) + 1)) for f, (v, bounds) in enumerate(zip(own, mixing.BINS.values(), strict=True))))
        e = np.exp(np.array(total) - max(total))
        logs[i] = e / e.sum()
    for r in mixing.rates(members, m).collect():
        assert np.allclose([r.p_1, r.p_0], logs[r.doc_id], atol=1e-8)


def test_copies_follow_the_rates(spark, rng):
    _, docs, labels = mixed(spark, rng)
    m, members = mixing.fit(docs, labels, {"1": 0.5, "0": 0.5})
    rate = {r.doc_id: r.rate for r in mixing.rates(members, m).collect()}
    taken = Counter(r.doc_id for r in mixing.apply(docs, m).collect())
    assert all(math.floor(rate[d]) <= taken[d] <= math.ceil(rate[d]) for d in rate)
    assert abs(sum(taken.values()) - sum(rate.values())) < 40
    assert mixing.apply(docs, m).columns == docs.columns


def test_mixing_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, "1"), (1, "1"), (3, "0"), (None, "1")], "doc_id bigint, domain string")
    for df, lab in ((odd, labels), (odd, labels.limit(0)), (none, labels)):
        m, members = mixing.fit(df, lab, mixing.TARGETS)
        assert mixing.rates(members, m).count() == df.count()
        assert mixing.apply(df, m).columns == df.columns


# Toxicity


@pytest.fixture
def toxic(spark, rng):
    rows, labels = [], []
    for i in range(600):
        ws = prose(rng, rng.randrange(10, 120)).split()
        bad = i % 7 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(["Vile,", "nastyx", "hateful", "slurrish"]) + rng.choice(["", "", "ing"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_documents(spark, toxic):
    rows, labels = toxic
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = toxicity.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id bigint, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    held = [(got[d].score, y) for d, y in labels if d % 3 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    near = [e for r in got.values() for e in r.evidence]
    assert near and all(0 < e.similarity <= 1.0001 and e.toxic in (0, 1) for e in near)


def test_scores_against_dense_vectors(spark, toxic):
    """Neighbours, votes and scores again from whole matrices, with and without the smaller vocabulary, and without the document itself."""
    rows, labels = toxic
    docs = spark.createDataFrame([*rows, (900, rows[7][1]), (901, "none of these"), (902, None)], "doc_id bigint, text string")
    index = toxicity.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id bigint, toxic int"))
    counts = {}
    for r in docs.collect():
        data, offsets = words.text_buffers(pa.array([r.text], pa.string()))
        counts[r.doc_id] = toxicity.term_counts(data, offsets)[1:]
    text = dict(docs.collect())
    n_docs = len(text)

    def vector(d, vocabulary, df, whole):
        h, c = counts[d]
        at = {t: i for i, t in enumerate(vocabulary.tolist())}
        out, norm = np.zeros(len(vocabulary)), 0.0
        for t, k in zip(h.tolist(), c.tolist(), strict=True):
            if t in at or whole:
                idf = math.log((1 + n_docs) / (1 + (df[t] if t in at else 1))) + 1e-3
                norm += ((1 + math.log(k)) * idf) ** 2
                if t in at:
                    out[at[t]] = (1 + math.log(k)) * idf
        return out / math.sqrt(norm) if norm else out

    df = Counter(t for h, _ in counts.values() for t in h.tolist())
    sides = {}
    for whole, vocabulary in ((False, index.vocabulary), (True, index.whole.vocabulary)):
        sides[whole] = vocabulary, np.stack([vector(int(i), vocabulary, df, whole) for i in index.ids])
    got = {r.doc_id: r for r in toxicity.score(docs, index, own="doc_id").collect()}
    outside = 0
    for d, r in got.items():
        whole = not np.isin(counts[d][0], index.vocabulary).any()
        vocabulary, examples = sides[whole]
        s = examples @ vector(d, vocabulary, df, whole)
        s[index.ids == str(d)] = 0
        near = sorted((-x, i) for i, x in enumerate(s) if x > 0)[: toxicity.NEIGHBOURS]
        w = np.array([-x for x, _ in near]) ** toxicity.POWER
        vote = float((w * index.label[[i for _, i in near]]).sum() / (w.sum() + toxicity.ABSENT)) if near else -1.0
        a, b = index.whole.curve if whole and index.whole.curve else index.curve
        want = index.blank if vote < 0 or whole and index.whole.curve is None else 1 / (1 + math.exp(-(a * vote + b)))
        outside += whole
        assert r.score == pytest.approx(want, abs=2e-4), d
        assert str(d) not in {e.example for e in r.evidence}
    assert outside > 10


def test_block_bounds_lose_no_neighbour(rng):
    n_terms, n = 300, 500
    vocabulary = np.arange(1, n_terms + 1).astype(np.uint64)
    docs = []
    for _ in range(n):
        t = np.unique(np.array([int(rng.paretovariate(0.7)) % n_terms for _ in range(rng.randrange(1, 40))]))
        docs.append((vocabulary[t], np.array([rng.randrange(1, 5) for _ in t])))
    df = np.bincount(np.concatenate([h.astype(int) - 1 for h, _ in docs]), minlength=n_terms)
    label = np.array([rng.randrange(2) for _ in range(n)])
    index = toxicity.build(np.array([str(i) for i in range(n)], object), label, docs, vocabulary, df, n, (n - label.sum(), label.sum()))
    dense = np.zeros((n, n_terms), np.float32)
    of = {x: i for i, x in enumerate(index.ids)}
    for i, (h, c) in enumerate(docs):
        dense[of[str(i)], h.astype(int) - 1] = index.weights(h.astype(int) - 1, c)
    for q in range(0, n, 7):
        t = np.flatnonzero(dense[q])
        at, s = index.nearest(t, dense[q][t], 10)
        want = np.sort(dense @ dense[q])[::-1][:10]
        want = want[want > 0]
        assert len(at) == len(want) and np.allclose(s, want, atol=1e-5)
        assert np.allclose(dense[at] @ dense[q], s, atol=1e-5)


def test_copies_of_examples_toxic_by_rare_words_are_found(spark, toxic):
    rows, labels = toxic
    rare = [(1000 + i, " ".join(f"rare{i}x{j}" for j in range(30))) for i in range(2)]
    copies = [(2000 + i, t) for i, (_, t) in enumerate(rare)]
    docs = spark.createDataFrame([*rows, *rare, *copies], "doc_id bigint, text string")
    index = toxicity.fit(docs, spark.createDataFrame([*labels, *[(d, 1) for d, _ in rare]], "doc_id bigint, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    for i in range(2):
        assert got[2000 + i].score > 0.5 and got[2000 + i].evidence[0].example == str(1000 + i)
    w, n = index.whole, len(index.ids)
    dense = np.zeros((n, len(w.vocabulary)))
    for i in range(n):
        dense[i, w.term[w.bounds[i] : w.bounds[i + 1]]] = w.own[w.bounds[i] : w.bounds[i + 1]]
    for i in range(0, n, 17):
        t = np.flatnonzero(dense[i])
        want = np.sort(np.delete(dense @ dense[i], i))[::-1][:15]
        assert np.allclose(w.nearest(t, dense[i][t], 15, skip=i)[1], want[want > 0], atol=1e-5)


def test_toxicity_odd_rows(spark, odd, none):
    lab = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, 0), (None, 1), (6, None)], "doc_id bigint, toxic int")
    for df, x in ((odd, lab), (odd, lab.limit(0)), (none, lab)):
        index = toxicity.fit(df, x)
        got = toxicity.score(df, index, tuple(df.columns), names=("__s", "__e")).collect()
        assert len(got) == df.count() and all(0 <= r["__s"] <= 1 for r in got)


# Language model


def tokens_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_tree(train):
    """Counts of every context and next byte, up to the depth."""
    c = Counter()
    for t in train:
        s = b"\t" * lm.DEPTH + b"".join(w.encode() + b" " for w in tokens_of(t)) + b"\n"
        for i in range(lm.DEPTH, len(s)):
            for d in range(lm.DEPTH + 1):
                c[s[i - d : i], s[i]] += 1
    return c


def brute_score(c, t):
    """The score by definition: retained contexts, smoothed towards the parent's."""
    totals = Counter()
    for (ctx, _), n in c.items():
        totals[ctx] += n
    every = totals[b""]
    nexts = {}
    for (ctx, b), n in c.items():
        nexts.setdefault(ctx, {})[b] = n

    def p(ctx, b):
        if not ctx:
            return (c[b"", b] + 1) / (every + 256)
        if totals[ctx] < lm.least_count(every) or ctx not in nexts:
            return p(ctx[1:], b)
        pull = lm.PULL * len(nexts[ctx])
        return (c[ctx, b] + pull * p(ctx[1:], b)) / (totals[ctx] + pull)

    kept = {b""}
    for ctx in nexts:
        if ctx and totals[ctx] >= lm.least_count(every) and (len(ctx) == 1 or sum(n * math.log(p(ctx, b) / p(ctx[1:], b)) for b, n in nexts[ctx].items()) >= lm.GAIN):
            kept |= {ctx[k:] for k in range(len(ctx))}
    s = b"\t" * lm.DEPTH + b"".join(w.encode() + b" " for w in tokens_of(t)) + b"\n"
    out = 0.0
    for i in range(lm.DEPTH, len(s)):
        ctx = s[i - lm.DEPTH : i]
        while ctx not in kept:
            ctx = ctx[1:]
        out += math.log10(p(ctx, s[i]))
    return out


def test_scores_are_those_of_the_definition(spark, rng):
    train = [prose(rng, rng.randrange(5, 60), 30).upper() for _ in range(60)] + ["É été", None]
    other = [prose(rng, 20, 30), "unseen words zz", "", None, "É"]
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = lm.fit(frame(train))
    counts = Counter(w for t in train for w in [*tokens_of(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    assert (model.tokens, model.types) == (n, v)
    tree = brute_tree(train)
    for r in lm.score(frame(other), model).collect():
        ws = [*tokens_of(other[r.doc_id]), "\n"]
        assert (r.n_tokens, r.n_known) == (len(ws), sum(counts[w] > 0 for w in ws))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score == pytest.approx(brute_score(tree, other[r.doc_id]))


def test_a_tree_in_parts_scores_alike(spark, rng, monkeypatch):
    docs = spark.createDataFrame([(i, prose(rng, rng.randrange(200), 200)) for i in range(40)] + [(7, "Ünd É"), (None, None)], "doc_id bigint, text string")
    exact = lambda df: sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 8), round(r.score, 8)) for r in df.collect())
    want = exact(lm.score(docs, lm.fit(docs)))
    monkeypatch.setattr(lm, "MAX_MOVES", 150)
    model = lm.fit(docs)
    assert len(model.parts) > 3 and exact(lm.score(docs, model)) == want


def test_candidates_grow_with_the_corpus():
    assert [lm.least_count(n) for n in (0, 1000, 10**6, 10**9, 10**12)] == [2, 2, 5, 2000, 20_000]


def test_next_bytes_sum_to_one(rng):
    data, offsets = words.text_buffers(pa.array([prose(rng, 300, 20) for _ in range(20)]))
    code, _ = lm.grams(words.split(data, offsets, words.NOT_SPACE, lower=True))
    levels = []
    for d in range(1, lm.DEPTH + 1):
        key, n = np.unique(code & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True)
        levels.append((key >> np.uint64(8), (key & np.uint64(255)).astype(np.int64), n))
    seen = np.bincount((code & np.uint64(255)).astype(int), minlength=256)
    tree = lm.grow(levels, (seen + 1) / (seen.sum() + 256))
    assert len(tree.levels[0].context) > 0
    for context in np.unique(code >> np.uint64(8))[::50]:
        p = tree.probability((context << np.uint64(8)) | np.arange(256, dtype=np.uint64))
        assert p.sum() == pytest.approx(1.0) and (p > 0).all()


def test_heavy_and_rare_words_give_one_base(spark, rng, monkeypatch):
    docs = spark.createDataFrame([(i, prose(rng, 50, 40)) for i in range(30)], "doc_id bigint, text string")
    want = {r.doc_id: (r.n_known, pytest.approx(r.base_score)) for r in lm.score(docs, lm.fit(docs)).collect()}
    for heavy in (0.05, 2.0):
        monkeypatch.setattr(lm, "HEAVY", heavy)
        got = {r.doc_id: (r.n_known, r.base_score) for r in lm.score(docs, lm.fit(docs)).collect()}
        assert got == want


def test_lm_odd_rows(spark, odd, none):
    model = lm.fit(odd)
    assert lm.score(odd, model).count() == odd.count()
    assert lm.score(none, model).count() == 0
    empty = lm.fit(none)
    got = lm.score(odd, empty).collect()
    assert len(got) == odd.count() and all(r.n_known == 0 and math.isfinite(r.score) for r in got)


def test_the_tree_predicts_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = lm.fit(docs.filter(~lm.held_out()))
    own = lm.score(docs.filter(lm.held_out()), model).toPandas()
    assert len(own) > 50 and own.score.sum() > own.base_score.sum()
