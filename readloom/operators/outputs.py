"""What leaves a run: routed reads and sidecars, as projections of operators.workflow.run()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.operators.workflow import reason_label
from readloom.schema import Presence, escaped


def _presence(result: DataFrame) -> Presence:
    names = set(result.columns)
    return Presence("r2_seq" in names, "r1_qual" in names, "r1_header" in names, "flag" in names)


def _processed(result: DataFrame, m: int, has: Presence, as_mate: int) -> list[Column]:
    header = f"r{m}_tagged" if f"r{m}_tagged" in result.columns else f"r{m}_header"
    return [F.col(f"r{m}.seq").alias(f"r{as_mate}_seq"), *[F.col(f"r{m}.qual").alias(f"r{as_mate}_qual")] * has.quality, *[F.col(header).alias(f"r{as_mate}_header")] * has.headers]


def accepted(result: DataFrame) -> DataFrame:
    """Accepted records in the input's schema: sequences and qualities cut alike."""
    return _take(result, "accepted")


def _take(result: DataFrame, disposition: str) -> DataFrame:
    has = _presence(result)
    rows = result.filter(F.col("disposition") == disposition)
    return rows.select("record_index", *[c for m in has.mates for c in _processed(result, m, has, m)], *["flag"] * has.flags)


def failed(result: DataFrame, mode: str = "original") -> DataFrame:
    """Rejected records, as they came in or as processed."""
    if mode not in ("original", "processed"):
        raise ValueError("mode is original or processed")
    if mode == "processed":
        return _take(result, "rejected")
    return result.filter("disposition = 'rejected'").select(*_presence(result).columns())


def orphans(result: DataFrame, mate: int) -> DataFrame:
    """Mates that passed alone, processed and single-end."""
    has = _presence(result)
    return result.filter(F.col("disposition") == f"orphan_r{mate}").select("record_index", *_processed(result, mate, has, 1), *["flag"] * has.flags)


def reason_rows(result: DataFrame, adapters: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())) -> DataFrame:
    """A row for each mate of every record that was not accepted; `adapters` are the declared names of each mate."""
    has = _presence(result)

    def row(m: int) -> Column:
        r = F.col(f"r{m}")
        names = F.array(*[F.lit(x) for x in adapters[m - 1]]) if adapters[m - 1] else F.array().cast("array<string>")
        return F.struct(
            F.lit(f"R{m}").alias("mate"),
            F.when(r["reasons"] == 0, "PASS").otherwise("FAIL").alias("status"),
            reason_label(r["reasons"]).alias("reasons"),
            r["original_length"].alias("original_length"),
            r["adapter_trimmed_length"].alias("adapter_trimmed_length"),
            (r["end"] - r["start"]).alias("final_length"),
            F.coalesce(F.get(names, r["adapter"]), F.lit(".")).alias("adapter_name"),
            F.coalesce(r["adapter_start"].cast("string"), F.lit(".")).alias("adapter_start"),
        )

    rows = result.filter("disposition <> 'accepted'")
    return rows.select("record_index", F.inline(F.array(*[row(m) for m in has.mates])))


def correction_reads(result: DataFrame) -> DataFrame:
    """A row for each corrected pair."""
    has = _presence(result)
    header = lambda m: (escaped(F.col(f"r{m}_header")) if has.headers else F.lit(".")).alias(f"r{m}_header")
    o = F.col("overlap")
    return result.filter("overlap.corrected_r1 + overlap.corrected_r2 > 0").select(
        "record_index", header(1), header(2), o["offset"].alias("overlap_offset"), o["length"].alias("overlap_length"), o["mismatches"].alias("overlap_mismatches"),
        o["corrected_r1"].alias("corrected_r1_bases"), o["corrected_r2"].alias("corrected_r2_bases"), o["unresolved"].alias("unresolved_mismatches"), F.col("disposition").alias("final_disposition"),
    )


def correction_bases(result: DataFrame) -> DataFrame:
    """A row for each corrected base, by record, mate and place."""
    rows = result.select("record_index", F.inline("overlap.edits"), F.col("overlap.offset").alias("overlap_offset"), F.col("overlap.length").alias("overlap_length"), F.col("disposition").alias("final_disposition"))
    name = lambda c: F.concat(F.lit("R"), c.cast("string"))
    return rows.select(
        "record_index", name(F.col("mate")).alias("mate"), F.col("position").alias("read_position"), name(3 - F.col("mate")).alias("donor_mate"), "donor_position",
        F.col("original").alias("original_base"), F.col("corrected").alias("corrected_base"), "original_phred", "corrected_phred", "overlap_offset", "overlap_length", "final_disposition",
    )
