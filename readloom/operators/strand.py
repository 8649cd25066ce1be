"""Strandedness by k-mer pseudo-mapping: reads vote for transcripts by shared k-mers, the formats of the best decide.

Counts differ from an aligner's; the layers above the mapping, tally, gate and classification, do not depend on it.

Transcripts are a table (transcript, sequence and, if some are decoys, decoy) or FASTA; their k-mers can be stored as an
index and used again. Records are mapped in batches in order, until enough of them are informative. A record whose most
hits are on decoys alone counts as `decoy`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import scalars as fs
from readloom.operators.sample import with_offsets
from readloom.schema import Presence

#: Library formats by pair orientation and strand; single-end reads have only the strand.
FORWARD = ("ISF", "OSF", "MSF", "SF")
REVERSE = ("ISR", "OSR", "MSR", "SR")


@dataclass(frozen=True)
class StrandParams:
    k: int = 21
    batch: int = 8192
    target_informative: int = 50_000
    min_informative: int = 5000
    min_informative_fraction: float = 0.05
    stranded: float = 0.80
    unstranded: float = 0.10

    def validate(self) -> StrandParams:
        if self.k < 5 or self.batch < 1 or self.target_informative < 1 or self.min_informative < 0:
            raise ValueError("strand parameters are out of range")
        if not (0.5 < self.stranded <= 1 and 0 <= self.unstranded < 1 and 0 <= self.min_informative_fraction <= 1):
            raise ValueError("strand thresholds are out of range")
        if self.min_informative > self.target_informative:
            raise ValueError("min_informative is over target_informative")
        return self


def read_transcripts(spark: SparkSession, path: str, decoys: str | None = None) -> DataFrame:
    """(transcript, sequence, decoy) of a Parquet table or of FASTA, whose records are split where they are read; `decoys`
    is a text file of names."""
    if path.rstrip("/").rsplit(".", 1)[-1] in ("fa", "fasta", "fna", "gz"):
        records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
        head = F.substring_index("value", "\n", 1)
        body = F.substr("value", F.length(head) + 1, F.length("value"))
        rows = records.select(F.regexp_extract(head, r"^\s*(\S+)", 1).alias("transcript"), F.upper(F.regexp_replace(body, r"\s", "")).alias("sequence"))
    else:
        rows = spark.read.parquet(path)
    if decoys:
        names = spark.read.text(decoys).select(F.trim("value").alias("transcript"), F.lit(True).alias("listed")).distinct()
        marked = F.coalesce("listed", F.col("decoy") if "decoy" in rows.columns else F.lit(False))
        return rows.join(names, "transcript", "left").select("transcript", "sequence", marked.alias("decoy"))
    return rows if "decoy" in rows.columns else rows.withColumn("decoy", F.lit(False))


def build_index(transcripts: DataFrame, path: str, k: int) -> None:
    """Store the k-mers, sorted, so that scans can skip row groups."""
    kmer_index(transcripts, k).withColumn("k", F.lit(k)).repartition("kmer").sortWithinPartitions("kmer").write.parquet(path)


def load_index(spark: SparkSession, path: str, k: int) -> DataFrame:
    index = spark.read.parquet(path)
    stored = index.select("k").first()
    if stored is None or stored["k"] != k:
        raise ValueError(f"the index at {path} is for k = {stored and stored['k']}, not {k}: build it anew")
    return index.drop("k")


def kmer_index(transcripts: DataFrame, k: int) -> DataFrame:
    """(kmer, transcript, pos, decoy) of the sense strand of every transcript."""
    if "decoy" not in transcripts.columns:
        transcripts = transcripts.withColumn("decoy", F.lit(False))
    at = F.when(F.length("sequence") >= k, F.sequence(F.lit(1), F.length("sequence") - k + 1)).otherwise(F.array().cast("array<int>"))
    return transcripts.select("transcript", F.explode(F.transform(at, lambda i: F.struct(i.alias("pos"), F.substr("sequence", i, F.lit(k)).alias("kmer")))).alias("x"), "decoy").select("transcript", "x.pos", "x.kmer", "decoy")


def read_map(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(record_index, mate, transcript, sense, hits, pos, decoy): how many k-mers each mate shares with each transcript and strand."""
    has = Presence.of(reads)
    every = F.array(*[F.struct(F.lit(m).alias("mate"), F.lit(sense).alias("sense"), (F.col(f"r{m}_seq") if sense else fs.reverse_complement(F.col(f"r{m}_seq"))).alias("s")) for m in has.mates for sense in (True, False)])
    each = reads.select("record_index", F.inline(every)).select("record_index", "mate", "sense", F.explode(F.array_distinct(fs.kmers(F.col("s"), k))).alias("kmer"))
    return each.join(index, "kmer").groupBy("record_index", "mate", "transcript", "sense").agg(F.count("*").alias("hits"), F.min("pos").alias("pos"), F.first("decoy").alias("decoy"))


def formats(reads: DataFrame, transcripts: DataFrame, k: int) -> DataFrame:
    """(record_index, format): the one format on which a record's best mappings agree, `ambiguous`, or `decoy` if the best are
    on decoys alone; unmapped records are absent."""
    return formats_by(reads, kmer_index(transcripts, k), k)


def formats_by(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    has = Presence.of(reads)
    maps = read_map(reads, index, k)
    if has.paired:
        one, two = (maps.filter(F.col("mate") == m).select("record_index", "transcript", "decoy", F.col("sense").alias(f"s{m}"), F.col("hits").alias(f"h{m}"), F.col("pos").alias(f"p{m}")) for m in (1, 2))
        both = one.join(two.drop("decoy"), ["record_index", "transcript"]).withColumn("hits", F.col("h1") + F.col("h2"))
        sense_first = F.when(F.col("s1"), F.col("p1") <= F.col("p2")).otherwise(F.col("p2") <= F.col("p1"))
        side = F.when(F.col("s1") == F.col("s2"), "M").when(sense_first, "I").otherwise("O")
        both = both.withColumn("format", F.concat(side, F.lit("S"), F.when(F.col("s1"), "F").otherwise("R")))
    else:
        both = maps.withColumn("format", F.when(F.col("sense"), "SF").otherwise("SR"))
    # the most hits, and the formats that have them
    own = F.when(~F.col("decoy"), F.col("format"))
    by_hits = both.groupBy("record_index", "hits").agg(F.min(own).alias("a"), F.max(own).alias("b"))
    best = by_hits.groupBy("record_index").agg(F.max_by(F.struct("a", "b"), "hits").alias("f"))
    return best.select("record_index", F.when(F.col("f.a").isNull(), "decoy").when(F.col("f.a") == F.col("f.b"), F.col("f.a")).otherwise("ambiguous").alias("format"))


def tally(records: DataFrame) -> DataFrame:
    return records.groupBy("format").agg(F.count("*").alias("records"))


def stop_batch(records: DataFrame, params: StrandParams) -> int:
    """The first batch of `records` (ordinal, format) with which the target of informative ones is reached, or the last.

    A count a batch, summed in order; the batches of a sample are bounded by its size.
    """
    informative = F.col("format").isNotNull() & ~F.col("format").isin("ambiguous", "decoy")
    counts = records.groupBy(F.floor(F.col("ordinal") / params.batch).alias("b")).agg(F.count_if(informative).alias("n")).orderBy("b").collect()
    seen, last = 0, -1
    for r in counts:
        last, seen = r["b"], seen + r["n"]
        if seen >= params.target_informative:
            break
    return last


def stop_after(records: DataFrame, params: StrandParams) -> DataFrame:
    """Records up to the end of the batch that reaches the target."""
    return records.filter(F.floor(F.col("ordinal") / params.batch) <= stop_batch(records, params))


@dataclass
class StrandReport:
    decision: str
    failure_reason: str | None
    library_type: str | None
    strandedness: str
    orientation: str
    forward_fraction: float
    reverse_fraction: float
    informative: int
    examined: int
    ambiguous: int
    counts: dict[str, int]
    warnings: list[str]
    decoy_only: int = 0
    short: int = 0

    @property
    def featurecounts(self) -> int | None:
        return {"unstranded": 0, "forward": 1, "reverse": 2}.get(self.strandedness)

    @property
    def htseq(self) -> str | None:
        return {"unstranded": "no", "forward": "yes", "reverse": "reverse"}.get(self.strandedness)


def classify(counts: dict[str, int], examined: int, paired: bool, params: StrandParams = StrandParams()) -> StrandReport:
    """From records by format (and `ambiguous`) of `examined` records."""
    params.validate()
    ambiguous = counts.get("ambiguous", 0)
    forward = sum(counts.get(f, 0) for f in FORWARD)
    reverse = sum(counts.get(f, 0) for f in REVERSE)
    informative = forward + reverse
    share = lambda x, n: x / n if n else 0.0
    enough = informative > 0 and informative >= params.min_informative and share(informative, examined) >= params.min_informative_fraction
    f, r = share(forward, informative), share(reverse, informative)
    strand = "undetermined"
    if enough:
        strand = "forward" if f >= params.stranded else "reverse" if r >= params.stranded else "unstranded" if abs(f - r) < params.unstranded else "undetermined"
    sides = {name: sum(n for fmt, n in counts.items() if len(fmt) == 3 and fmt[0] == code) for name, code in (("inward", "I"), ("outward", "O"), ("matching", "M"))}
    orientation = max(sides, key=sides.get) if paired and enough and any(sides.values()) else "undetermined"
    library = None
    if enough:
        prefix = {"inward": "I", "outward": "O", "matching": "M"}.get(orientation, "") if paired else ""
        library = prefix + ({"forward": "SF", "reverse": "SR"}.get(strand, "U"))
    notes = [f"pairs are mostly {orientation}, not inward: check the library preparation"] if orientation in ("outward", "matching") else []
    decoys = counts.get("decoy", 0)
    if 4 * decoys > examined > 0:
        notes.append("over a quarter of the records map to decoys alone, which usually means genomic contamination")
    return StrandReport("confident" if strand != "undetermined" else "undetermined", None if enough else "insufficient_mapping_evidence", library, strand, orientation, f, r, informative, examined, ambiguous, dict(counts), notes, decoys)


def sniff(reads: DataFrame, transcripts: DataFrame, params: StrandParams = StrandParams()) -> StrandReport:
    """Map the given reads (a sample, say) in order, as many batches as it takes, and classify."""
    return sniff_by(reads, kmer_index(transcripts, params.validate().k), params)


def sniff_by(reads: DataFrame, index: DataFrame, params: StrandParams = StrandParams()) -> StrandReport:
    """With an index. Rounds of batches are mapped, each four times the one before, until one holds the stop."""
    params.validate()
    has = Presence.of(reads)
    columns = [f"r{m}_seq" for m in has.mates]
    # places by ranges of the index, so that no task sorts all records
    rows = with_offsets(reads.select("record_index", *columns)).withColumn("ordinal", F.col("record_index")).persist()
    try:
        total, seen, size, informative = rows.count(), 0, params.batch, 0
        counts: dict[str, int] = {}
        while seen < total:
            part = rows.filter((F.col("ordinal") >= seen) & (F.col("ordinal") < seen + size))
            found = part.select("record_index", "ordinal").join(formats_by(part.drop("ordinal"), index, params.k), "record_index", "left").persist()
            need = replace(params, target_informative=max(1, params.target_informative - informative), min_informative=0)
            last = min(total, seen + size, (stop_batch(found, need) + 1) * params.batch)
            for r in found.filter(F.col("ordinal") < last).groupBy("format").agg(F.count("*").alias("n")).collect():
                if r["format"]:
                    counts[r["format"]] = counts.get(r["format"], 0) + r["n"]
            found.unpersist()
            informative = sum(n for f, n in counts.items() if f not in ("ambiguous", "decoy"))
            seen, size = last, 4 * size
            if informative >= params.target_informative:
                break
        report = classify(counts, seen, has.paired, params)
        least = F.least(*[F.length(c) for c in columns]) if len(columns) > 1 else F.length(columns[0])
        report.short = rows.filter((F.col("ordinal") < seen) & (least < params.k)).count()
    finally:
        rows.unpersist()
    if report.short:
        report.warnings.append(f"{report.short} records are shorter than k = {params.k} and cannot be mapped")
    return report
