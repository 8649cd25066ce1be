import re
from hashlib import sha256

from conftest import prose

from readloom.llm import decontam


def brute(docs, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        ws = word(t)
        for k in range(max(1, len(ws) - 12) if ws else 0):
            windows.setdefault(tuple(ws[k : k + 13]), set()).add(str(i))
    out = []
    for d, t in docs:
        ws, hit, own = word(t), set(), set()
        for w, ids in windows.items():
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k : k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    own |= ids
        out.append((d, len(ws), len(hit), len(own), sha256(",".join(sorted(own)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


def test_hits_are_those_of_all_windows(spark, rng):
    items = [(i, prose(rng, rng.choice([2, 5, 13, 20, 40]), 30)) for i in range(25)] + [(100, None), (101, ""), (102, "Seven, EIGHT!"), (3, prose(rng, 14, 30))]
    docs = []
    for d in range(120):
        t = prose(rng, rng.choice([0, 5, 60, 300]), 30)
        if d % 3 == 0:
            t += " " + (rng.choice(items)[1] or "") + ". " + prose(rng, 20, 30)
        docs.append((d, t.upper() if d % 7 == 0 else t))
    docs += [(200, None), (201, "seven eight"), (202, "seven-eight é")]
    found = decontam.find_benchmark(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = decontam.digest(found).drop("n_near", "spans").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)


def test_proximity_and_spans(spark):
    item = " ".join(f"q{i}" for i in range(13))
    near = item.replace("q5", "other")
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, f"x {near} y")], "doc_id int, text string")
    rows = {r.doc_id: r for r in decontam.find_benchmark(docs, spark.createDataFrame([(7, item)], "item_id int, text string")).collect()}
    assert rows[1].spans[0].asDict() == {"start": 1, "end": 14} and rows[1].items == ["7"] and rows[1].n_near == 0
    assert rows[2].n_hit == 0 and rows[2].n_near == 1


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "plain text of"), (None, "id is null")], "item_id int, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in decontam.find_benchmark(odd, bench).collect())
    assert got == [(0, 4, 0), (1, 6, 3), (1, 6, 3), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 20000, 0), (6, 1, 0)]
    assert decontam.find_benchmark(none, bench).count() == 0
    assert {r.n_hit for r in decontam.find_benchmark(odd, bench.limit(0)).collect()} == {0}


def test_a_benchmark_of_many_blocks_gives_the_same(spark, rng, monkeypatch):
    items = [(i, prose(rng, rng.choice([2, 5, 13, 40]), 30)) for i in range(20)]
    items += [(50, items[3][1]), (51, prose(rng, 300, 30)), (None, "w1 w2"), (52, None)]  # windows of two items, an item of many blocks
    docs = [(d % 30, prose(rng, rng.choice([0, 60, 200]), 30) + " " + (rng.choice(items)[1] or "")) for d in range(60)] + [(None, items[21][1]), (90, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = lambda: sorted(map(str, decontam.find_benchmark(frame, bench).collect()))
    want = rows()
    monkeypatch.setattr(decontam, "MAX_WINDOWS", 150)
    assert decontam.count_windows(decontam.item_lists(bench, 7))[1] > 300
    assert rows() == want
