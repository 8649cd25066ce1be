"""Exact duplicates: the first record by input order stays, unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.schema import Presence


def _key(has: Presence) -> list[str]:
    return ["r1_seq", "r2_seq"] if has.paired else ["r1_seq"]


def _digest(reads: DataFrame, has: Presence) -> DataFrame:
    """A 256-bit digest of the sequences with their lengths, so that only it is shuffled."""
    parts = [x for c in _key(has) for x in (F.length(c).cast("string"), F.col(c))]
    return reads.withColumn("__key", F.unhex(F.sha2(F.concat_ws("|", *parts), 256)))


def groups(reads: DataFrame) -> DataFrame:
    """(key, n, first) of each distinct read or pair; counted before the shuffle, so a hot sequence is a few rows."""
    has = Presence.of(reads)
    return _digest(reads, has).groupBy("__key").agg(F.count("*").alias("n"), F.min("record_index").alias("first"))


def dedup(reads: DataFrame) -> DataFrame:
    """Records that are the first of their sequence (or ordered pair). Qualities, headers and flags do not count; N is a base."""
    has = Presence.of(reads)
    first = groups(reads).select(F.col("first").alias("record_index"))
    return reads.join(first, "record_index", "left_semi").select(*has.columns())


def stats(reads: DataFrame) -> DataFrame:
    """One row; candidates are the records and families of groups with more than one."""
    g = groups(reads)
    seen, kept = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint"), F.count("*").cast("bigint")
    more = F.col("n") > 1
    counts = g.agg(seen.alias("records_seen"), kept.alias("records_kept"), F.coalesce(F.sum(F.when(more, F.col("n"))), F.lit(0)).cast("bigint").alias("candidate_records"), F.count_if(more).cast("bigint").alias("candidate_families"))
    removed = F.col("records_seen") - F.col("records_kept")
    return counts.select("records_seen", "records_kept", removed.alias("duplicates_removed"), F.when(F.col("records_seen") == 0, F.lit(0.0)).otherwise(removed / F.greatest(F.col("records_seen"), F.lit(1))).alias("duplication_rate"), "candidate_records", "candidate_families")
