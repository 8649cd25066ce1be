import random

import pytest


@pytest.fixture
def rng():
    return random.Random(7)


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.paretovariate(0.9)) % words}" for _ in range(n))


#: Rows that every operator must bear: null and repeated ids, null, empty, blank and repeated texts, a very long one.
@pytest.fixture
def odd(spark):
    long = "longword " * 20_000
    rows = [(1, "a plain text of some words", "x", 9.0), (1, "a plain text of some words", "x", 9.0), (2, None, None, None), (3, "", "y", 1.0), (4, " \n\t ", "y", 1.0), (None, "id is null here", "z", 2.0), (5, long, "z", 2.0), (6, "é" * 3000, None, 0.0)]
    # extra columns whose names clash with what operators add
    return spark.createDataFrame(rows, "doc_id bigint, text string, results string, score double")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, results string, score double")
