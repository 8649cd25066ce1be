"""Token-ID output: a content-addressed store of id chunks with recipes and Merkle manifests.

A text becomes a stream of token ids with an end id. A rolling hash over eight ids
cuts the stream at content-defined places, each distinct chunk is stored once under
the SHA-256 of its bytes, a recipe a document lists its chunks in order, and manifests
hash documents into blocks, blocks into shards and shards into one root. A document's leaf is
the hash of its id, start and length with the hash of its chunk names.

Files under `path`: `chunks` (chunk_id, n_ids, payload), `recipes` (shard, pos, doc_id,
start, n_tokens, chunk_ids, sizes, root) in ascending doc_id order, `manifest` (shard, docs,
tokens, root) and `root` (shards, docs, tokens, root), one row. Payloads are zstd frames of
little-endian ids, of two bytes where the vocabulary allows it and else four. Reading
computes all hashes anew from what is stored and compares them upwards; a recipe or chunk
that is missing, changed or in another place, and a manifest row likewise, is an error.

Defined cases: null text is empty (its stream is the end id alone); null ids sort first;
repeated rows each get a recipe, equal ids in order of their content; an empty table
gives an empty store; very long texts are encoded whole; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import shared
from readloom.llm.words import mix, runs

END_ID = 2
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 256, 10, 8192
CACHE_PIECES = 2_000_000
#: Documents in one block of the Merkle tree.
BLOCK = 1024
# White space, letters and numbers of the first 256 code points, as the tokenizer's own pattern classes them.
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(9, 14), 0x20, 0x85, 0xA0]] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_CLASS[[*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
_MULTIPLIER = 0x9E3779B97F4A7C15
SLICE_CHARS = 2_000_000


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces that the tokenizer's pattern cuts texts of code points below 256 into, without apostrophes.

    A run of letters, numbers or other signs is a piece, with a blank before it if there is one. White space before
    that is one piece, or two where its last character is no blank: that one stands alone. At a text's end it is one.
    """
    n = len(data)
    kind = _CLASS[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    fresh = edge[:-1].copy()
    fresh[1:] |= kind[1:] != kind[:-1]
    begins = fresh.copy()
    visible = np.flatnonzero(fresh & (kind != _SPACE))
    visible = visible[~edge[visible]]  # what has something before it in its text
    before = data[visible - 1]
    blank = before == 0x20
    begins[visible[blank]] = False
    begins[visible[blank] - 1] = True
    begins[visible[~blank & (kind[visible - 1] == _SPACE)] - 1] = True
    return np.flatnonzero(begins)


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each piece."""
    h = size.astype(np.uint64) * np.uint64(_MULTIPLIER)
    g = ~h
    wide = data.astype(np.uint64) + np.uint64(0x100)
    live, k = np.arange(len(start)), 0
    while len(live):
        c = wide[start[live] + k]
        h[live] = (h[live] ^ c) * np.uint64(0xD6E8FEB86659FD93)
        h[live] ^= h[live] >> np.uint64(32)
        g[live] = (g[live] + c) * np.uint64(0xBF58476D1CE4E5B9)
        g[live] ^= g[live] >> np.uint64(29)
        k += 1
        live = live[size[live] > k]
    return mix(h), mix(g)


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Byte-level BPE merges only inside the pieces that its pattern cuts a text into. So each distinct piece, told by
    128 bits of hash, is encoded by the library once and remembered as a place in a pool of ids. Texts for which the
    pattern is not written out here are encoded whole: those with code points over 255, apostrophes or `<|`.
    """

    def __init__(self, definition: bytes):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_buffer(definition)
        self.width = np.dtype("<u2" if self.lib.get_vocab_size() < 1 << 16 else "<u4")
        kinds = str(getattr(self.lib.pre_tokenizer, "__getstate__", lambda: b"")())
        self.by_piece = "ByteLevel" in kinds and "add_prefix_space\":false" in kinds and self.lib.normalizer is None
        self._forget()

    def _forget(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.place, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.width)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian bytes."""
        out: list[bytes] = [b""] * len(texts)
        fast: list[tuple[int, bytes]] = []
        slow: list[int] = []
        for i, text in enumerate(texts):
            if self.by_piece and "'" not in text and "<|" not in text:
                try:
                    fast.append((i, text.encode("latin-1")))
                    continue
                except UnicodeEncodeError:
                    pass
            slow.append(i)
        for i, ids in zip(slow, self.whole([texts[i] for i in slow]), strict=True):
            out[i] = ids
        at = 0
        while at < len(fast):
            end, chars = at + 1, len(fast[at][1])
            while end < len(fast) and chars + len(fast[end][1]) <= SLICE_CHARS:
                chars += len(fast[end][1])
                end += 1
            for (i, _), ids in zip(fast[at:end], self._encode([raw for _, raw in fast[at:end]]), strict=True):
                out[i] = ids
            at = end
        return out

    def _encode(self, raws: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(raws), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
        start = pieces(data, offsets)
        size = np.diff(np.append(start, len(data)))
        key, check = hashes(data, start, size)
        order = np.argsort(key)
        first, times = runs(key[order])
        one = order[first]
        at = self._places(data, start[one], size[one], key[one], check[one])
        which = np.empty(len(key), np.int64)
        which[order] = np.repeat(at, times)
        count = self.count[which]
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(self.place[which] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(start, offsets)] * self.width.itemsize
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _places(self, data, start, size, key, check) -> np.ndarray:
        """Where the distinct pieces, in order of key, are remembered; new ones are learnt."""
        at = np.searchsorted(self.key, key)
        known = self.key[np.minimum(at, len(self.key) - 1)] == key if len(self.key) else np.zeros(len(key), bool)
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.key) > CACHE_PIECES:  # what came first is common
                keep = self.place < np.partition(self.place, CACHE_PIECES // 2)[CACHE_PIECES // 2]
                self.key, self.check, self.place, self.count = (x[keep] for x in (self.key, self.check, self.place, self.count))
                self.pool = self.pool[: int((self.place + self.count).max(initial=0))]
                return self._places(data, start, size, key, check)
            texts = [data[a : a + n].tobytes().decode("latin-1") for a, n in zip(start[new].tolist(), size[new].tolist(), strict=True)]
            ids, place, counts = self._learn(texts)
            place += len(self.pool)
            self.pool = np.concatenate([self.pool, ids])
            self.key, self.check = np.insert(self.key, at[new], key[new]), np.insert(self.check, at[new], check[new])
            self.place, self.count = np.insert(self.place, at[new], place), np.insert(self.count, at[new], counts)
            at = np.searchsorted(self.key, key)
        if (self.check[at] != check).any():
            raise ValueError("two pieces share a hash")
        return at

    def _learn(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, places, counts) of pieces; those of a blank and letters are encoded as one text, which the pattern cuts into them again."""
        joins = np.array([p[0] == " " and p[-1].isalpha() for p in texts], bool)
        row, rest = np.flatnonzero(joins), np.flatnonzero(~joins)
        counts = np.zeros(len(texts), np.int64)
        ids = []
        if len(row):
            made = self.lib.encode("".join([texts[i] for i in row.tolist()]), add_special_tokens=False)
            word = np.array(made.word_ids)
            if len(row) != word[-1] + 1:
                raise ValueError("pieces and words of the tokenizer differ")
            counts[row] = np.bincount(word)
            ids += made.ids
        for i, e in zip(rest.tolist(), self.lib.encode_batch_fast([texts[i] for i in rest.tolist()], add_special_tokens=False), strict=True):
            counts[i] = len(e.ids)
            ids += e.ids
        places = np.zeros(len(texts), np.int64)
        order = np.concatenate([row, rest])
        places[order] = np.cumsum(counts[order]) - counts[order]
        return np.array(ids, self.width), places, counts


@functools.lru_cache(maxsize=4)
def encoder(definition: bytes) -> Encoder:
    """One for each Python worker, so what it has learnt serves the tasks after."""
    return Encoder(definition)


@functools.lru_cache(maxsize=1)
def _gear(n: int) -> np.ndarray:
    """A random 64-bit number for each id."""
    return mix(np.arange(1, n + 1, dtype=np.uint64))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream, decided by the eight ids before each place."""
    n = len(ids)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _gear(1 << 16)[ids] if ids.itemsize == 2 else mix(ids.astype(np.uint64) + np.uint64(1))
    p = np.uint64(_MULTIPLIER)
    for step in (1, 2, 4):
        g = h.copy()
        g[step:] += h[:-step] * p
        h, p = g, np.uint64(int(p) ** 2 % (1 << 64))
    at = np.flatnonzero((h * np.uint64(_MULTIPLIER)) >> np.uint64(64 - MEAN_BITS) == 0) + 1
    out, last = [], 0
    for c in [*at.tolist(), n]:
        while c - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if c - last >= MIN_CHUNK or c == n and c > last:
            out.append(last := c)
    return out


def _encode_batches(definition: Broadcast[bytes], end_id: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import zstandard

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own, pack = encoder(definition.value), zstandard.ZstdCompressor(level=3)
        end = np.array([end_id], own.width).tobytes()
        for batch in batches:
            ids_col, sizes_col, payload_col, totals, roots = [], [], [], [], []
            for raw in own.encode([text or "" for text in batch.column("text").to_pylist()]):
                raw += end
                ids = np.frombuffer(raw, own.width)
                names, sizes, payloads, at = [], [], [], 0
                for c in cuts(ids):
                    part = raw[at * own.width.itemsize : c * own.width.itemsize]
                    names.append(hashlib.sha256(part).digest())
                    sizes.append(c - at)
                    payloads.append(pack.compress(part))
                    at = c
                ids_col.append(names)
                sizes_col.append(sizes)
                payload_col.append(payloads)
                totals.append(len(ids))
                roots.append(hashlib.sha256(b"".join(names)).digest())
            arrays = [batch.column("doc_id"), totals, ids_col, sizes_col, payload_col, roots]
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return run


def write_store(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, shards: int | None = None) -> None:
    """Encode every text of `docs` (doc_id, text) into a new store at `path`."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("chunk_ids", T.ArrayType(T.BinaryType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("payloads", T.ArrayType(T.BinaryType())), T.StructField("root", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    staging = f"{path}/_staging"
    definition = spark.sparkContext.broadcast(Path(tokenizer_file).read_bytes())  # a file of the driver: a vocabulary's size
    docs.select("doc_id", "text").mapInArrow(_encode_batches(definition, end_id, to_arrow_schema(schema)), schema).write.option("compression", "none").parquet(f"{staging}/encoded")
    encoded = spark.read.schema(schema).parquet(f"{staging}/encoded")

    (encoded.select(F.explode(F.arrays_zip("chunk_ids", "sizes", "payloads")).alias("c"))
        .select(F.col("c.chunk_ids").alias("chunk_id"), F.col("c.sizes").alias("n_ids"), F.col("c.payloads").alias("payload"))
        .dropDuplicates(["chunk_id"]).write.option("compression", "none").parquet(f"{path}/chunks"))

    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (encoded.select("doc_id", "n_tokens", "chunk_ids", "sizes", "root").repartitionByRange(shards, "doc_id", "root").sortWithinPartitions("doc_id", "root")
        .withColumn("shard", F.spark_partition_id()).write.parquet(f"{staging}/ordered"))
    ordered = spark.read.parquet(f"{staging}/ordered")
    # one number a shard reaches the driver
    totals = sorted((r["shard"], r["n"]) for r in ordered.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, before = [], 0
    for shard, n in totals:
        offsets.append((shard, before))
        before += n
    offset = F.broadcast(spark.createDataFrame(offsets, "shard int, before long"))
    w = Window.partitionBy("shard").orderBy("doc_id", "root")
    (ordered.join(offset, "shard").withColumn("pos", F.row_number().over(w)).withColumn("start", F.col("before") + F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
        .select("shard", "pos", "doc_id", "start", "n_tokens", "chunk_ids", "sizes", "root").write.parquet(f"{path}/recipes"))
    shards_of(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    spark.createDataFrame([root_of(spark.read.parquet(f"{path}/manifest"))], ROOT).coalesce(1).write.parquet(f"{path}/root")
    shared.remove(spark, staging)


ROOT = "shards int, docs long, tokens long, root string"


def shards_of(recipes: DataFrame) -> DataFrame:
    """(shard, docs, tokens, root) from recipes: leaves in order of their place, hashed by block, and blocks by shard."""
    leaf = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("start").cast("string"), F.col("n_tokens").cast("string"), F.hex("root")), 256)
    joined = lambda a: F.sha2(F.array_join(F.transform(F.sort_array(a), lambda x: x["hash"]), ""), 256)
    blocks = recipes.groupBy("shard", F.floor((F.col("pos") - 1) / BLOCK).alias("block")).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), joined(F.collect_list(F.struct("pos", leaf.alias("hash")))).alias("root"))
    return blocks.groupBy("shard").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), joined(F.collect_list(F.struct("block", F.col("root").alias("hash")))).alias("root"))


def root_of(manifest: DataFrame) -> tuple[int, int, int, str]:
    """The row over all shards, which are as many as shuffle partitions."""
    rows = sorted(tuple(r) for r in manifest.select("shard", "docs", "tokens", "root").collect())
    return len(rows), sum(r[1] for r in rows), sum(r[2] for r in rows), hashlib.sha256("".join(f"{shard}:{docs}:{tokens}:{root};" for shard, docs, tokens, root in rows).encode()).hexdigest()


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raise if recipes, manifest and root differ in anything."""
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    stored = [tuple(r) for r in spark.read.schema(ROOT).parquet(f"{path}/root").collect()]
    if stored != [root_of(manifest)]:
        raise ValueError("the manifest does not match the store's root")
    now, then = ({r["shard"]: tuple(r) for r in df.select("shard", "docs", "tokens", "root").collect()} for df in (shards_of(recipes), manifest))
    if wrong := sorted(s for s in now.keys() | then.keys() if now.get(s) != then.get(s)):
        raise ValueError(f"recipes do not match the manifest in shards {wrong[:10]}")


# CRC-32 of a concatenation from the CRCs of its parts: multiplication modulo the CRC polynomial.
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    out, bit = 0, 1 << 31
    while True:
        if a & bit:
            out ^= b
            if not a & (bit - 1):
                return out
        bit >>= 1
        if not bit:
            return out
        b = (b >> 1) ^ _POLY if b & 1 else b >> 1


@functools.lru_cache(maxsize=100_000)
def _shift(n_bytes: int) -> int:
    """x to the power 8 * n_bytes."""
    out, square, n = 1 << 31, 1 << 23, n_bytes
    while n:
        if n & 1:
            out = _times(square, out)
        square = _times(square, square)
        n >>= 1
    return out


def crc_join(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of parts given as (crc, bytes), in order."""
    out = 0
    for crc, size in parts:
        out = _times(_shift(size), out) ^ crc
    return out


def _check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        names, crcs, sizes = [], [], []
        for name, n, payload in zip(batch.column("chunk_id").to_pylist(), batch.column("n_ids").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            raw = unpack.decompress(payload)
            if hashlib.sha256(raw).digest() != name or len(raw) % n:
                raise ValueError(f"chunk {name.hex()} is damaged")
            names.append(name)
            crcs.append(zlib.crc32(np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes()))
            sizes.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int32())], ["chunk_id", "crc", "n"])


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, sizes = [], []
        for parts in batch.column("parts").to_pylist():
            if any(p["crc"] is None for p in parts):
                raise ValueError("a chunk of a recipe is missing")
            out.append(crc_join([(p["crc"], 4 * p["n"]) for p in parts]))
            sizes.append(sum(p["n"] for p in parts))
        keep = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
        if sizes != keep[2].to_pylist():
            raise ValueError("a recipe and its chunks differ in length")
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """Read a store back: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers).

    Recipes are held against the manifest and its root first. Every stored chunk is unpacked where it is read and
    must hash to its name; its CRC, not its bytes, is joined to the recipes, and the CRCs of a document's chunks give
    that of the whole.
    """
    check_manifest(spark, path)
    shared.small_batches(spark)
    recipes, chunks = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/chunks")
    sums = chunks.mapInArrow(_check_chunks, "chunk_id binary, crc long, n int")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    rooted = F.unhex(F.sha2(F.unhex(F.array_join(F.transform("chunk_ids", lambda x: F.hex(x)), "")), 256))
    good = recipes.withColumn("chunk_ids", F.when(rooted == F.col("root"), F.col("chunk_ids")).otherwise(F.raise_error(F.lit("a recipe does not match its root"))))
    parts = good.select("shard", "pos", "doc_id", "start", "n_tokens", F.posexplode("chunk_ids").alias("ord", "chunk_id"))
    joined = parts.join(sums, "chunk_id", "left").groupBy("shard", "pos").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("ord", "crc", "n"))).alias("parts"))
    return joined.select("doc_id", "start", "n_tokens", "parts").mapInArrow(_join_parts, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Whole streams: doc_id, start, ids."""
    shared.small_batches(spark)
    recipes, chunks = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/chunks")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    parts = recipes.select("shard", "pos", "doc_id", "start", F.posexplode("chunk_ids").alias("ord", "chunk_id")).join(chunks, "chunk_id")
    whole = parts.groupBy("shard", "pos").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sort_array(F.collect_list(F.struct("ord", "n_ids", "payload"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = []
            for ps in batch.column("parts").to_pylist():
                raws = [(unpack.decompress(p["payload"]), p["n_ids"]) for p in ps]
                ids.append(np.concatenate([np.frombuffer(r, f"<u{len(r) // n}") for r, n in raws]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return whole.select("doc_id", "start", "parts").mapInArrow(run, f"doc_id {kind}, start long, ids array<long>")
