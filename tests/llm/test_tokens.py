import shutil
import zlib
from pathlib import Path

import numpy as np
import pytest
from conftest import prose

from readloom.llm import queries, tokens


@pytest.fixture
def encoder():
    return tokens.Encoder(Path(queries.tokenizer_file()).read_bytes())


def test_pieces_give_the_library_s_ids(encoder, rng):
    parts = ["a", "the", " ", "  ", "\n", "\t", ".", ",", "'s", "'t", "É", "é.", "1", "23", "²", "<|endoftext|>", "\x1c", "\x85", "\xa0", "　", "日本", "\r\n", "_", "word", " Word", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    want = [np.array(e.ids, encoder.width).tobytes() for e in encoder.lib.encode_batch(texts, add_special_tokens=False)]
    for a in range(0, len(texts), 500):
        assert encoder.encode(texts[a : a + 500]) == want[a : a + 500]


def test_memory_is_bounded_and_forgetting_changes_nothing(encoder, rng, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    texts = [prose(rng, 60) for _ in range(40)]
    want = [np.array(e.ids, encoder.width).tobytes() for e in encoder.lib.encode_batch(texts, add_special_tokens=False)]
    assert [encoder.encode([t])[0] for t in texts] == want
    assert len(encoder.key) <= 50 + 200


def test_cuts_follow_the_content(rng):
    ids = np.array([rng.randrange(50_000) for _ in range(40_000)], "<u2")
    ends = tokens.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= tokens.MAX_CHUNK and (sizes[:-1] >= tokens.MIN_CHUNK).all()
    moved = tokens.cuts(np.concatenate([ids[:10], ids]))
    assert len({e - 10 for e in moved} & set(ends)) > 0.8 * len(ends)
    assert tokens.cuts(ids[:3]) == [3] and tokens.cuts(ids[:0]) == []


def test_crc_of_parts():
    raw = bytes(range(256)) * 5
    parts = [raw[:7], raw[7:600], raw[600:]]
    assert tokens.crc_join([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(raw)


def stored(spark, docs, path):
    tokens.write_store(docs, path, queries.tokenizer_file())
    return tokens.verify_store(spark, path).collect()


def test_round_trip(spark, rng, tmp_path, encoder):
    long = prose(rng, 9000)
    rows = [(i, prose(rng, rng.choice([0, 3, 50, 800]))) for i in range(40)] + [(100, long), (101, "x " + long), (102, long), (103, None), (104, "")]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in stored(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path / "s"))}
    whole = {r.doc_id: r for r in tokens.read_store(spark, str(tmp_path / "s")).collect()}
    start = 0
    for d, t in sorted(rows):
        ids = [*encoder.lib.encode(t or "", add_special_tokens=False).ids, tokens.END_ID]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert whole[d].ids == ids and whole[d].start == start
        start += len(ids)
    chunks = spark.read.parquet(str(tmp_path / "s" / "chunks"))
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    total = spark.read.parquet(str(tmp_path / "s" / "recipes")).selectExpr("sum(size(chunk_ids))").first()[0]
    assert chunks.count() < total  # copies share chunks
    manifest = spark.read.parquet(str(tmp_path / "s" / "manifest")).selectExpr("sum(docs)", "sum(tokens)").first()
    assert tuple(manifest) == (len(rows), start)


def test_damage_is_seen(spark, tmp_path):
    path = str(tmp_path / "s")
    stored(spark, spark.createDataFrame([(1, "some text"), (2, "other text")], "doc_id int, text string"), path)
    c = spark.read.parquet(f"{path}/chunks").collect()
    spark.createDataFrame([(c[0].chunk_id, c[0].n_ids, c[1].payload), (c[1].chunk_id, c[1].n_ids, c[1].payload)], "chunk_id binary, n_ids int, payload binary").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="damaged"):
        tokens.verify_store(spark, path).collect()


def rewrite(spark, path, df):
    df = spark.createDataFrame(df.collect(), df.schema)
    df.write.mode("overwrite").parquet(path)


@pytest.mark.parametrize("what", ["recipe file", "chunk file", "manifest row", "manifest", "root", "swapped ids", "swapped places", "start", "length"])
def test_every_loss_and_change_is_seen(spark, rng, tmp_path, what):
    path = str(tmp_path / "s")
    docs = spark.createDataFrame([(i, prose(rng, 40 + i)) for i in range(60)], "doc_id int, text string")
    assert len(stored(spark, docs, path)) == 60
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    swap = lambda c: spark.createDataFrame([{**r.asDict(), c: {7: 8, 8: 7}.get(r.doc_id, None) or r[c]} for r in recipes.collect()], recipes.schema)
    if what in ("recipe file", "chunk file"):
        folder = Path(path) / (what.split()[0] + "s")
        max(folder.glob("part-*.parquet"), key=lambda f: f.stat().st_size).unlink()
    elif what == "manifest row":
        rewrite(spark, f"{path}/manifest", manifest.filter(f"shard <> {manifest.first().shard}"))
    elif what == "manifest":
        shutil.rmtree(f"{path}/manifest")
    elif what == "root":
        rewrite(spark, f"{path}/root", spark.read.parquet(f"{path}/root").selectExpr("shards", "docs + 1 docs", "tokens", "root"))
    elif what == "swapped ids":
        rewrite(spark, f"{path}/recipes", swap("doc_id"))
    elif what == "swapped places":
        rows = recipes.collect()
        shard = rows[0].shard
        p = sorted(r.pos for r in rows if r.shard == shard)
        rewrite(spark, f"{path}/recipes", recipes.selectExpr("shard", f"case when shard = {shard} and pos = {p[0]} then {p[1]} when shard = {shard} and pos = {p[1]} then {p[0]} else pos end pos", "doc_id", "start", "n_tokens", "chunk_ids", "sizes", "root"))
    elif what == "start":
        rewrite(spark, f"{path}/recipes", recipes.selectExpr("shard", "pos", "doc_id", "start + int(doc_id = 9) start", "n_tokens", "chunk_ids", "sizes", "root"))
    else:
        rewrite(spark, f"{path}/recipes", recipes.selectExpr("shard", "pos", "doc_id", "start", "n_tokens + int(doc_id = 9) n_tokens", "chunk_ids", "sizes", "root"))
    with pytest.raises(Exception, match="manifest|recipe|root|infer schema"):
        tokens.verify_store(spark, path).collect()


def test_odd_rows(spark, odd, none, tmp_path):
    got = stored(spark, odd, str(tmp_path / "a"))
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 2, 3, 4, 5, 6]
    assert [r.start for r in sorted(got, key=lambda r: r.start)][0] == 0 and min(got, key=lambda r: r.start).doc_id is None
    assert stored(spark, none, str(tmp_path / "b")) == []
