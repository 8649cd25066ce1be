"""Reads as tables. Which columns exist says what a data set holds; absent ones are never made up.

record_index BIGINT, r1_seq STRING [, r1_qual] [, r1_header] [, r2_seq [, r2_qual] [, r2_header]] [, flag DECIMAL(20,0)]
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Presence:
    """The four switches of a data set: 16 schemas."""

    paired: bool
    quality: bool
    headers: bool
    flags: bool

    @classmethod
    def of(cls, reads: DataFrame) -> Presence:
        names = set(reads.columns)
        for need in ("record_index", "r1_seq"):
            if need not in names:
                raise ValueError(f"reads need the column {need}")
        paired = "r2_seq" in names
        for kind in ("qual", "header"):
            if paired and (f"r1_{kind}" in names) != (f"r2_{kind}" in names) or not paired and f"r2_{kind}" in names:
                raise ValueError(f"{kind} columns must be there for each mate or for none")
        return cls(paired, "r1_qual" in names, "r1_header" in names, "flag" in names)

    @property
    def mates(self) -> tuple[int, ...]:
        return (1, 2) if self.paired else (1,)

    def columns(self) -> list[str]:
        """In the order of storage."""
        per = [["seq"], ["qual"] * self.quality, ["header"] * self.headers]
        return ["record_index", *[f"r{m}_{c}" for m in self.mates for part in per for c in part], *["flag"] * self.flags]

    def unpaired(self) -> Presence:
        return Presence(False, self.quality, self.headers, self.flags)


def reads_of(df: DataFrame) -> DataFrame:
    """The read columns of `df`, in the order of storage."""
    return df.select(*Presence.of(df).columns())


def checked(reads: DataFrame) -> DataFrame:
    """`reads` where a sequence and its quality have one length and quality bytes are 33 to 126; else the job fails."""
    has = Presence.of(reads)
    if not has.quality:
        return reads
    out = reads
    for m in has.mates:
        s, q = F.col(f"r{m}_seq"), F.col(f"r{m}_qual")
        where = F.concat(F.lit("record "), F.col("record_index").cast("string"), F.lit(f", R{m}: "))
        bad_length, bad_byte = F.length(s) != F.length(q), ~q.rlike("^[!-~]*$")
        value = F.when(bad_length, F.raise_error(F.concat(where, F.lit("sequence and quality differ in length")))).when(bad_byte, F.raise_error(F.concat(where, F.lit("a quality byte is outside 33 to 126")))).otherwise(q)
        out = out.withColumn(f"r{m}_qual", value)
    return out


def escaped(header: Column) -> Column:
    """A header in a sidecar: backslash, tab and line ends written out."""
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        header = F.replace(header, F.lit(raw), F.lit(shown))
    return header
