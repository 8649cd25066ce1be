"""The run report: additive aggregates over the facts of a run, one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.kernels.match import LINKED_LABELS
from readloom.kernels.trim import OPS, REASONS, TrimParams
from readloom.operators.workflow import reason_label


def _mates(result: DataFrame) -> tuple[int, ...]:
    return (1, 2) if "r2_seq" in result.columns else (1,)


def total(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast("bigint")


def count_if(x: Column) -> Column:
    return F.count_if(F.coalesce(x, F.lit(False))).cast("bigint")


def _final(m: int) -> Column:
    return F.col(f"r{m}.end") - F.col(f"r{m}.start")


def counts(result: DataFrame) -> DataFrame:
    """One row: records by disposition, bases in, out and orphaned by mate, and which mates failed."""
    d, mates = F.col("disposition"), _mates(result)
    bad = {m: F.col(f"r{m}.reasons") != 0 for m in mates}
    not_in = d != "accepted"
    two = bad.get(2, F.lit(False))
    out = [F.count("*").cast("bigint").alias("records_in"), count_if(d == "accepted").alias("records_out"), count_if(d == "rejected").alias("records_rejected")]
    for m in mates:
        out += [count_if(d == f"orphan_r{m}").alias(f"orphaned_r{m}"), total(F.col(f"r{m}.original_length")).alias(f"bases_in_r{m}"), total(F.when(d == "accepted", _final(m))).alias(f"bases_out_r{m}"), total(F.when(d == f"orphan_r{m}", _final(m))).alias(f"bases_orphaned_r{m}")]
    out += [count_if(not_in & bad[1] & ~two).alias("r1_only_failed"), count_if(not_in & ~bad[1] & two).alias("r2_only_failed"), count_if(not_in & bad[1] & two).alias("both_failed")]
    return result.agg(*out)


def by_mate(result: DataFrame) -> DataFrame:
    """mate and its facts, one row a read."""
    return result.select("record_index", "disposition", F.inline(F.array(*[F.struct(F.lit(f"R{m}").alias("mate"), F.col(f"r{m}").alias("f")) for m in _mates(result)])))


def adapters(result: DataFrame) -> DataFrame:
    """Per mate: reads and bases that adapters, flanks or the overlap took, and those of the overlap alone."""
    gone = F.col("f.original_length") - F.col("f.adapter_trimmed_length")
    over = F.col("f.overlap_removed")
    return by_mate(result).groupBy("mate").agg(count_if(gone > 0).alias("adapter_reads"), total(gone).alias("adapter_bases"), count_if(over > 0).alias("overlap_reads"), total(over).alias("overlap_bases"))


def adapter_hits(result: DataFrame, declared: tuple[tuple[str, ...], tuple[str, ...]]) -> DataFrame:
    """Hits of each declared adapter, those without any too."""
    spark = result.sparkSession
    rows = [(f"R{m}", k, name) for m, names in enumerate(declared, 1) for k, name in enumerate(names)]
    names = spark.createDataFrame(rows, "mate string, adapter int, name string")
    hits = by_mate(result).filter("f.adapter is not null").groupBy("mate", F.col("f.adapter").alias("adapter")).agg(F.count("*").alias("hits"))
    return names.join(hits, ["mate", "adapter"], "left").select("mate", "name", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))


def trims(result: DataFrame, params: tuple[TrimParams, TrimParams] | None = None) -> DataFrame:
    """Per mate and trim: reads and bases that it took. With `params`, a row for each trim that is on, also one that took
    nothing, and else for those that took something."""
    mates = _mates(result)
    on = [(m, k, op) for m in mates for k, op in enumerate(OPS) if params is None or op in params[m - 1].enabled]
    gone = {(m, k): F.get(F.col(f"r{m}.removed"), F.lit(k)) for m, k, _ in on}
    sums = result.agg(*[x for m, k, _ in on for x in (count_if(gone[m, k] > 0).alias(f"n{m}_{k}"), total(gone[m, k]).alias(f"b{m}_{k}"))]) if on else None
    if sums is None:
        return result.sparkSession.createDataFrame([], "mate string, op string, reads long, bases long")
    rows = [F.struct(F.lit(f"R{m}").alias("mate"), F.lit(op).alias("op"), F.col(f"n{m}_{k}").alias("reads"), F.col(f"b{m}_{k}").alias("bases")) for m, k, op in on]
    out = sums.select(F.inline(F.array(*rows)))
    return out if params else out.filter("reads > 0")


def reasons(result: DataFrame) -> DataFrame:
    """Mates that failed for each reason; one mate may have several."""
    sums = by_mate(result).agg(*[count_if(F.col("f.reasons").bitwiseAND(1 << k) != 0).alias(name) for k, name in enumerate(REASONS)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(name).alias("reason"), F.col(name).alias("mates")) for name in REASONS])))


def combinations(result: DataFrame) -> DataFrame:
    """Records not accepted by the reasons of both mates together."""
    bits = F.col("r1.reasons").bitwiseOR(F.coalesce(F.col("r2.reasons"), F.lit(0)))
    return result.filter("disposition <> 'accepted'").groupBy(bits.alias("bits")).agg(F.count("*").alias("records")).select(reason_label(F.col("bits")).alias("reasons"), "records")


def correction(result: DataFrame) -> DataFrame:
    """One row: what correction saw and did."""
    o = F.col("overlap")
    one, two = F.coalesce(o["corrected_r1"], F.lit(0)), F.coalesce(o["corrected_r2"], F.lit(0))
    return result.agg(
        F.count("*").cast("bigint").alias("pairs_examined"), count_if(o.isNotNull()).alias("overlapping_pairs"), total(o["mismatches"]).alias("mismatches"), count_if(o["mismatches"] > 0).alias("pairs_with_mismatches"),
        total(o["unresolved"]).alias("unresolved"), total(o["noncanonical"]).alias("skipped_noncanonical"), count_if(one + two > 0).alias("corrected_pairs"), count_if((one > 0) & (two > 0)).alias("corrected_both_mates"),
        count_if(one > 0).alias("corrected_reads_r1"), count_if(two > 0).alias("corrected_reads_r2"), total(one).alias("corrected_bases_r1"), total(two).alias("corrected_bases_r2"),
    )


def substitutions(result: DataFrame) -> DataFrame:
    """Corrected bases by what they were and became."""
    return result.select(F.inline("overlap.edits")).groupBy("original", "corrected").agg(F.count("*").alias("bases"))


def corrections_per_pair(result: DataFrame) -> DataFrame:
    n = F.col("overlap.corrected_r1") + F.col("overlap.corrected_r2")
    return result.filter(n > 0).groupBy(n.alias("corrections"), "disposition").agg(F.count("*").alias("pairs"))


def linked(result: DataFrame) -> DataFrame:
    """Per mate: how flanks were found, and bases before and behind the inserts (behind the clip of a UMI)."""
    f = F.col("f")
    matched = f["linked"] == LINKED_LABELS[0]
    return by_mate(result).groupBy("mate").agg(
        count_if(matched & f["linked_five"] & f["linked_three"]).alias("both"), count_if(matched & f["linked_five"] & ~f["linked_three"] | (f["linked"] == "five_only")).alias("five_only"),
        count_if(matched & ~f["linked_five"] & f["linked_three"] | (f["linked"] == "three_only")).alias("three_only"), count_if(f["linked"] == "neither").alias("neither"),
        count_if(f["linked"] == "insert_too_short").alias("short_insert"), count_if(f["linked"] == "out_of_order").alias("invalid_order"),
        total(F.when(matched, f["linked_leading"])).alias("leading_bases"), total(F.when(matched, f["linked_trailing"])).alias("trailing_bases"),
    )


def umi(result: DataFrame) -> DataFrame:
    """One row: tagged records, and the bases that their tags took."""
    taken = sum((F.col(f"umi_clip_r{m}") for m in _mates(result)), F.lit(0))
    return result.agg(F.count("*").cast("bigint").alias("records_tagged"), total(taken).alias("bases_removed"))


def quality_metrics(reads: DataFrame, residue: str) -> DataFrame:
    """One row on R1: mean length, share of qualities of 30 and more, and reads with `residue` inside in parts per million."""
    good = F.length("r1_qual") - F.length(F.regexp_replace("r1_qual", "[?-~]", ""))
    n = F.greatest(F.count("*"), F.lit(1))
    return reads.agg(F.count("*").cast("bigint").alias("reads"), F.avg(F.length("r1_seq")).alias("mean_length"), (F.sum(good) / F.nullif(F.sum(F.length("r1_qual")), F.lit(0))).alias("q30"), (F.count_if(F.contains("r1_seq", F.lit(residue))) * 1e6 / n).alias("residue_ppm"))


def kept_pairs(reads: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row: records of the input and of the output, and those of both, by their indices."""
    ids = reads.select("record_index").join(accepted.select(F.col("record_index"), F.lit(True).alias("kept")), "record_index", "full_outer")
    return ids.agg(F.count("*").cast("bigint").alias("records"), count_if(F.col("kept")).alias("kept"))
