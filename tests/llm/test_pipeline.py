import re

import corpus_pipeline
from readloom.llm import minhash, mixing, queries, toxicity


def word_list(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def leaks(text, items):
    """A whole window of 13 words anywhere; no item here is shorter."""
    ws = word_list(text)
    grams = {tuple(ws[i : i + 13]) for i in range(len(ws) - 12)}
    return any(tuple(b[i : i + 13]) in grams for b in map(word_list, items) for i in range(len(b) - 12))


def test_a_passage_in_a_long_text_is_dropped(spark, rng, tmp_path):
    passage = [f"q{i}" for i in range(13)]
    filler = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(1, " ".join(filler(2500) + passage + filler(2500))), (2, " ".join(filler(2500) + passage[:12] + filler(2500))), (3, None), (4, " ".join(filler(9) + ["short", "item"])), (5, " ".join(filler(400) + ["short", "item"]))]
    docs = spark.createDataFrame([(*r, "mine", 7) for r in rows], "doc_id int, text string, text_key string, row_key int")
    spark.createDataFrame([("a", " ".join(filler(5) + passage + filler(5))), ("b", "Short, item!"), ("c", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.decontaminate_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {(r.doc_id, r.text_key, r.row_key) for r in out.collect()} == {(i, "mine", 7) for i in (2, 3, 5)}


def test_columns_of_any_name_are_carried(spark, rng):
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    docs = spark.createDataFrame([(None, text, "a", "b", "c", 1), (5, text, "d", "e", "f", 2), (4, text + " more", "g", "h", "i", 3), (9, None, "j", "k", "l", 4)], "doc_id int, text string, row_key string, copies string, copies_ string, SCORE int")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(tuple(r)[2:] for r in kept.collect()) == [("g", "h", "i", 3), ("j", "k", "l", 4)]
    m, _ = mixing.fit(docs, spark.createDataFrame([(4, "1"), (9, "0")], "doc_id int, domain string"), mixing.TARGETS)
    assert {(r.doc_id, r.copies, r.copies_) for r in mixing.apply(docs, m).collect()} <= {(r.doc_id, r.copies, r.copies_) for r in docs.collect()}


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontaminate", "mix", "tokens"]

    one = stages["toxicity"](spark, docs, sf).cache()
    index = queries.toxicity_index(docs, queries.table(spark, sf, "labels"))
    want = [r.doc_id for r in toxicity.score(docs, index).filter("score < 0.5").collect()]
    assert sorted(ids(one)) == sorted(want) and one.columns == columns and len(want) < docs.count()

    two = stages["near_dedup"](spark, one, sf).cache()
    assert sorted(ids(two)) == sorted({r.class_id for r in minhash.classes(one).collect()}) and two.columns == columns

    three = stages["decontaminate"](spark, two, sf).cache()
    bad = {r.doc_id for r in two.collect() if leaks(r.text, [b.text for b in queries.table(spark, sf, "benchmark").collect()])}
    assert bad and set(ids(three)) == set(ids(two)) - bad and three.columns == columns

    four = stages["mix"](spark, three, sf).cache()
    m, members = mixing.fit(three, queries.quality_labels(spark, sf), mixing.TARGETS)
    rate = {r.doc_id: r.rate for r in mixing.rates(members, m).collect()}
    taken = ids(four)
    assert four.columns == columns and all(int(rate[d]) <= taken.count(d) <= int(rate[d]) + 1 for d in rate)

    five = stages["tokens"](spark, four, sf).collect()
    assert sorted(r.doc_id for r in five) == sorted(taken)
    assert sum(r.n_tokens for r in five) == max(r.start + r.n_tokens for r in five)


def test_run_and_an_empty_table(spark, sf, tmp_path):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and set(out.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_steps_leave_one_folder_that_can_be_removed(spark, odd):
    from pathlib import Path

    from readloom.llm import shared

    minhash.classes(odd).count()
    own = Path(shared.own_folder(spark).removeprefix("file://"))
    assert any(own.iterdir())
    shared.clean(spark)
    assert not own.exists()
