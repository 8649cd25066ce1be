from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose

from readloom.llm import minhash, words


def bag(text):
    ws = text.split()
    return Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else Counter()


def similarity(a, b):
    x, y = bag(a), bag(b)
    more = sum((x | y).values())
    return sum((x & y).values()) / more if more else 0.0


def brute(docs):
    """class_id by union of all pairs."""
    root = {i: i for i in range(len(docs))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    texts = [t or "" for _, t in docs]
    for i in range(len(docs)):
        for j in range(i):
            if texts[i].split() and (texts[i] == texts[j] or similarity(texts[i], texts[j]) >= 0.8):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        members[find(i)].append(d)
    return sorted((d, min(x for x in m if x is not None), len(m)) for m in members.values() for d in m if d is not None)


def edited(rng, text, n):
    ws = text.split()
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"edit{rng.random()}"
    return " ".join(ws)


def test_classes_are_those_of_all_pairs(spark, rng):
    texts = [prose(rng, rng.choice([3, 8, 30, 60, 200])) for _ in range(60)]
    hub = prose(rng, 60)
    texts += [edited(rng, rng.choice(texts), rng.choice([0, 1, 1, 2])) for _ in range(120)]
    texts += [hub] + [edited(rng, hub, 1) for _ in range(150)]  # linked through the hub alone, mostly
    texts += ["a b a b a b a b a b a b", "a b a b a b a b a b a b a b", "", None, "  "]
    docs = list(enumerate(texts))
    got = minhash.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(docs)


def test_signatures_estimate_the_weighted_similarity():
    a = " ".join(f"w{i}" for i in range(200))
    b = " ".join(f"w{i}" for i in range(20, 220))
    c = a + " " + a + " " + a
    w = words.split(*words.text_buffers(pa.array([a, b, c])), words.NOT_SPACE, lower=False)
    sig = minhash.signatures(*minhash.multiset(*words.shingles(w, 5)), 3, 8192)
    for x, y, t in ((0, 1, (a, b)), (0, 2, (a, c)), (1, 2, (b, c))):
        assert abs((sig[x] == sig[y]).mean() - similarity(*t)) < 0.03


def test_overlap_is_exact(rng):
    texts = [prose(rng, n, 12) for n in (1, 4, 5, 6, 40, 40)] + [""]
    pairs = [(a, b) for a in texts for b in texts]
    got = minhash.overlap(*words.text_buffers(pa.array([a for a, _ in pairs])), *words.text_buffers(pa.array([b for _, b in pairs])))
    assert np.allclose(got, [similarity(a, b) for a, b in pairs])


def test_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.class_id, r.class_size) for r in minhash.classes(odd).collect()}
    assert got == {(1, 1, 2), (2, 2, 1), (3, 3, 1), (4, 4, 1), (None, None, 1), (5, 5, 1), (6, 6, 1)}
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert minhash.classes(none).count() == 0 and minhash.keep_one(none).count() == 0


@pytest.mark.parametrize("edges", [[(1, 2), (3, 2), (4, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], []])
def test_components(spark, edges):
    key = lambda i: bytes([i])
    df = spark.createDataFrame([(key(a), key(b)) for a, b in edges], "a binary, b binary")
    got = {r.tid[0]: r.comp[0] for r in minhash.components(df).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a)
        root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert got == root


def test_no_planted_link_is_missed(rng):
    """Pairs by similarity: what share meets in a band, and passes the sketch."""
    pairs = []
    for _ in range(1500):
        n = rng.randrange(60, 400)
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(0, max(1, n // 30))):
            b[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        pairs.append((" ".join(a), " ".join(b)))
    sides = []
    for k in (0, 1):
        w = words.split(*words.text_buffers(pa.array([p[k] for p in pairs])), words.NOT_SPACE, lower=False)
        row, h, count = minhash.multiset(*words.shingles(w, minhash.WIDTH))
        sides.append(minhash.signatures(row, h, count, len(pairs)))
    similar = minhash.overlap(*(x for k in (0, 1) for x in words.text_buffers(pa.array([p[k] for p in pairs]))))
    meets = (minhash.band_keys(sides[0]) == minhash.band_keys(sides[1])).any(1)
    agree = (sides[0] == sides[1]).sum(1)
    linked = similar >= minhash.THRESHOLD
    assert linked.sum() > 1000 and (similar[linked] < 0.9).sum() > 200
    assert meets[linked].all() and (agree[linked] >= minhash.AGREE).all()
    assert abs(agree.mean() / sides[0].shape[1] - similar.mean()) < 0.01  # unbiased
