"""UMI extraction: a tag in the headers of both mates, and the bases to clip, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.plans.config import UmiStage
from readloom.schema import Presence

#: A header's index part starts behind the last `:` that has two characters behind it at least, and, for
#: the first index, ends at the first `+` behind it that has two.
_INDEX1 = r"(?s)^.*:(?=..)(.*?)(?:\+(?=..).*)?$"
_INDEX2 = r"(?s)^.*[:+](?=..)(.*)$"


def index1(header: Column) -> Column:
    bad = (F.length(header) < 5) | ~header.rlike(r"(?s):..")
    return F.when(bad, F.raise_error(F.concat(F.lit("no index in the header: "), header))).otherwise(F.regexp_extract(header, _INDEX1, 1))


def index2(header: Column) -> Column:
    bad = (F.length(header) < 5) | ~header.rlike(r"(?s)[:+]..")
    return F.when(bad, F.raise_error(F.concat(F.lit("no index in the header: "), header))).otherwise(F.regexp_extract(header, _INDEX2, 1))


def from_read(seq: Column, length: int, skip: int, record: Column) -> Column:
    """The first bases; a read shorter than they and the skipped ones is an error."""
    short = F.raise_error(F.concat(F.lit("record "), record.cast("string"), F.lit(f": the read is shorter than {length + skip} bases")))
    return F.when(F.length(seq) < length + skip, short).otherwise(F.substr(seq, F.lit(1), F.lit(length)))


def tagged(header: Column, tag: Column) -> Column:
    """The tag before the first blank, or at the end."""
    at = F.instr(header, " ")
    return F.when(at > 0, F.concat(F.substr(header, F.lit(1), at - 1), tag, F.substr(header, at, F.length(header)))).otherwise(F.concat(header, tag))


def umi_parts(stage: UmiStage) -> list[Column]:
    read = lambda m: from_read(F.col(f"r{m}_seq"), stage.length, stage.skip, F.col("record_index"))
    return {
        "read1": lambda: [read(1)],
        "read2": lambda: [read(2)],
        "per_read": lambda: [read(1), read(2)],
        "index1": lambda: [index1(F.col("r1_header"))],
        "index2": lambda: [index2(F.col("r2_header"))],
        "per_index": lambda: [index1(F.col("r1_header")), index2(F.col("r2_header"))],
    }[stage.location]()


def clips(stage: UmiStage) -> tuple[int, int]:
    n = stage.length + stage.skip
    return (n if stage.location in ("read1", "per_read") else 0, n if stage.location in ("read2", "per_read") else 0)


def with_umi(reads: DataFrame, stage: UmiStage, has: Presence) -> DataFrame:
    """`reads` with umi, umi_clip_r1 [, umi_clip_r2] and the new headers as r*_tagged; sequences are left whole."""
    stage.validate(has.paired, has.headers)
    umi = F.concat_ws("_", *umi_parts(stage))
    tag = F.concat(F.lit(stage.delimiter + (stage.prefix + "_" if stage.prefix else "")), F.col("umi"))
    out = reads.withColumn("umi", umi)
    for m in has.mates:
        out = out.withColumn(f"umi_clip_r{m}", F.lit(clips(stage)[m - 1])).withColumn(f"r{m}_tagged", tagged(F.col(f"r{m}_header"), tag))
    return out


def extract(reads: DataFrame, stage: UmiStage) -> DataFrame:
    """The stage alone: reads with tagged headers and clipped sequences and qualities."""
    has = Presence.of(reads)
    out = with_umi(reads, stage, has)
    for m in has.mates:
        n = clips(stage)[m - 1]
        out = out.withColumn(f"r{m}_header", F.col(f"r{m}_tagged"))
        for c in ("seq", *["qual"] * has.quality):
            if n:
                out = out.withColumn(f"r{m}_{c}", F.substr(F.col(f"r{m}_{c}"), F.lit(n + 1), F.length(f"r{m}_{c}")))
    return out.select(*has.columns())
