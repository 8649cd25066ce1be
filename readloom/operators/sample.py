"""Evenly spaced sampling as a predicate on the record's place: no shuffle, no random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sampled(offset: Column, total: int, size: int) -> Column:
    """Whether the i-th of `size` sample points, floor((2i + 1) * total / 2 size), is this offset for some i."""
    size = min(size, total)
    if size <= 0:
        return F.lit(False)
    whole = lambda x: F.lit(x).cast("decimal(20,0)")
    numerator = whole(2 * size) * offset.cast("decimal(18,0)") - whole(total)
    # the least i whose point is not before the offset
    i = F.when(numerator <= 0, 0).otherwise(F.call_function("div", numerator + whole(2 * total - 1), whole(2 * total)))
    point = F.call_function("div", (i * 2 + 1).cast("decimal(18,0)") * whole(total), whole(2 * size))
    return (i < size) & (point == offset)


def span(reads: DataFrame, start: int = 0, end: int | None = None, total: int | None = None, clamp: bool = False) -> DataFrame:
    """Records from `start` up to `end` (excluded). A start beyond the end, or beyond `total`, is an error unless clamped."""
    if end is not None and start > end or total is not None and start > total:
        if not clamp:
            raise ValueError(f"span {start}..{end} is outside the input")
        return reads.limit(0)
    out = reads.filter(F.col("record_index") >= start)
    return out if end is None else out.filter(F.col("record_index") < end)


def sample(reads: DataFrame, size: int, start: int = 0, end: int | None = None) -> DataFrame:
    """At most `size` records, evenly spaced over the span; record indices must be 0 to n - 1."""
    if size < 1:
        raise ValueError("the sample must be at least 1")
    total = reads.count()
    start, end = min(start, total), min(end if end is not None else total, total)
    own = span(reads, start, max(start, end))
    return own.filter(sampled(F.col("record_index") - start, max(end - start, 0), size))


def with_offsets(reads: DataFrame) -> DataFrame:
    """`reads` with record_index replaced by each record's rank, 0 to n - 1: ranks within ranges of the index, plus what
    the ranges before hold. One count a range reaches the driver."""
    spark = reads.sparkSession
    ranged = reads.repartitionByRange("record_index").sortWithinPartitions("record_index")
    edges = [r["e"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.max("record_index").alias("e")).orderBy("e").collect()][:-1]
    part = sum((F.when(F.col("record_index") > e, 1).otherwise(0) for e in edges), F.lit(0))
    placed = reads.withColumn("__part", part)
    sizes = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    starts, before = [], 0
    for p in range(len(edges) + 1):
        starts.append((p, before))
        before += sizes.get(p, 0)
    offsets = F.broadcast(spark.createDataFrame(starts, "__part int, __start long"))
    w = Window.partitionBy("__part").orderBy("record_index")
    ranked = placed.join(offsets, "__part").withColumn("__rank", F.col("__start") + F.row_number().over(w) - 1)
    return ranked.withColumn("record_index", F.col("__rank")).select(*reads.columns)
