import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import words

TEXT = st.text(alphabet=st.sampled_from(list("ab \n\t.Z9é日")), max_size=40)


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=200, deadline=None)
def test_split_is_the_regular_expression(texts):
    data, offsets = words.text_buffers(pa.array(texts, pa.string()))
    w = words.split(data, offsets, words.NOT_SPACE, lower=False)
    got = [[w.text(i) for i in np.flatnonzero(w.row == r)] for r in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    low = words.split(data, offsets, words.ALNUM, lower=True)
    want = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    assert [[low.text(i) for i in np.flatnonzero(low.row == r)] for r in range(len(texts))] == want
    by_text = {}
    for i in range(len(w.hash)):
        assert by_text.setdefault(w.text(i), w.hash[i]) == w.hash[i] == np.uint64(words.word_hash(w.text(i)))
    assert len(set(by_text.values())) == len(by_text)


@given(st.lists(TEXT, max_size=5))
@settings(max_examples=100, deadline=None)
def test_shingles_tell_runs_of_words_apart(texts):
    data, offsets = words.text_buffers(pa.array(texts, pa.string()))
    row, h = words.shingles(words.split(data, offsets, words.NOT_SPACE, lower=False), 3)
    want = []
    for t in texts:
        ws = t.split()
        want.append(sorted(tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))) if ws else [])
    assert [int((row == r).sum()) for r in range(len(texts))] == [len(x) for x in want]
    runs = {}
    for r, ws in enumerate(want):
        own = sorted(h[row == r].tolist())
        assert len(set(own)) == len(set(ws))
        if len(ws) == 1:
            assert runs.setdefault(ws[0], own[0]) == own[0]


def test_long_words_and_slices():
    data, offsets = words.text_buffers(pa.array(["x" * 500, None, "y"], pa.string()))
    w = words.split(data, offsets, words.NOT_SPACE, lower=False)
    assert w.counts().tolist() == [1, 0, 1] and len(set(w.hash.tolist())) == 2
    assert list(words.slices(np.array([0, 5, 9, 30, 31]), 9)) == [(0, 2), (2, 3), (3, 4)]
