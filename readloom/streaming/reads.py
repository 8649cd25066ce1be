"""The stateless stages on streams, and duplicates within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import outputs, workflow
from readloom.plans.config import Plan


def accepted(reads: DataFrame, plan: Plan) -> DataFrame:
    """Accepted reads of a stream: the stages keep no state, so the batch plan runs unchanged."""
    return outputs.accepted(workflow.run(reads, plan))


def dedup(reads: DataFrame, event_time: str, delay: str) -> DataFrame:
    """One read of each sequence within the watermark; which one is not the first by index, unlike the batch operator."""
    keys = ["r1_seq", *["r2_seq"] * ("r2_seq" in reads.columns)]
    return reads.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def counts(reads: DataFrame, plan: Plan, event_time: str, delay: str, width: str) -> DataFrame:
    """Reads by disposition in windows of event time; late ones beyond the watermark are left out."""
    kept = workflow.run(reads, plan).withWatermark(event_time, delay)
    return kept.groupBy(F.window(event_time, width), "disposition").agg(F.count("*").alias("records"))
