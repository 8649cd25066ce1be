"""Splitting single-end reads at internal delimiters: one row a fragment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import ship
from readloom.kernels import bytes as kb
from readloom.kernels import segment as ks
from readloom.kernels import trim as kt
from readloom.operators.workflow import reason_label
from readloom.plans.config import SegmentPlan
from readloom.schema import Presence, escaped

_FIELDS = (
    "segment_index int, cut_start int, cut_end int, start int, end int, left_adapter string, right_adapter string, reasons int, removed array<int>, seq string, qual string"
)
_TYPES = {"int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
COUNTS = "candidates int, delimiters int, empty int, terminal int, short int, over_limit int, hits array<int>"


def run(reads: DataFrame, plan: SegmentPlan) -> DataFrame:
    """`reads` with `fragments` (array of what was emitted, in order) and `cuts` (counts of the read)."""
    ship.ensure(reads.sparkSession)
    has = Presence.of(reads)
    plan.validate(has.paired)
    struct = lambda spec: "struct<" + ", ".join(x.replace(" ", ":", 1) for x in spec.split(", ")) + ">"
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.schema)
    return reads.mapInArrow(_kernel(plan, has, reads.columns), f"{own}, fragments array<{struct(_FIELDS)}>, cuts {struct(COUNTS)}")


def _arrow(spec: str) -> pa.StructType:
    return pa.struct([(x.split(" ")[0], _TYPES[x.split(" ")[1]]) for x in spec.split(", ")])


def _kernel(plan: SegmentPlan, has: Presence, kept: list[str]):
    names = np.array([a.name for a in plan.delimiters], object)
    sequences = [a.sequence for a in plan.delimiters]
    fragment, counts = _arrow(_FIELDS), _arrow(COUNTS)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().astype(np.int32)))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, length = kb.matrix(batch.column("r1_seq"))
        q = kb.matrix(batch.column("r1_qual"))[0] if has.quality else None
        f = ks.segment(m, length, sequences, plan.match, plan.options)
        s, e = f.start, f.end
        own_m, own_q = m[f.row], q[f.row] if q is not None else None
        removed = np.zeros((len(s), len(kt.OPS)), np.int64)
        if plan.trim:
            s, e, removed = kt.trim(own_m, own_q, s, e, plan.trim)
        bits = kt.reasons(own_m, own_q, s, e, plan.filter) if plan.filter else np.zeros(len(s), np.int64)
        label = lambda w: pa.array(names[np.maximum(w, 0)] if len(names) else np.array([], object), pa.string(), mask=w < 0)
        i32 = lambda x: pa.array(x.astype(np.int32))
        values = pa.StructArray.from_arrays([i32(f.index), i32(f.start), i32(f.end), i32(s), i32(e), label(f.left), label(f.right), i32(bits), lists(removed), kb.strings(own_m, s, e), kb.strings(own_q, s, e) if q is not None else pa.nulls(len(s), pa.string())], fields=list(fragment))
        offsets = pa.array(np.searchsorted(f.row, np.arange(batch.num_rows + 1)).astype(np.int32))
        cuts = pa.StructArray.from_arrays([i32(x) for x in (f.candidates, f.delimiters, f.empty, f.terminal, f.short, f.over_limit)] + [lists(f.hits)], fields=list(counts))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.ListArray.from_arrays(offsets, values), cuts], [*kept, "fragments", "cuts"])

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("r1_seq")), 0))
            for part in kb.parts([size], batch.num_rows):
                yield one(batch.slice(part.start, part.stop - part.start))

    return run_batches


def fragments(result: DataFrame) -> DataFrame:
    """One row a fragment, with the read's columns."""
    return result.select(*[c for c in result.columns if c not in ("fragments", "cuts")], F.inline("fragments"))


def passed(result: DataFrame) -> DataFrame:
    """Fragments that pass, as single-end reads; the header names the cut."""
    has = Presence.of(result)
    rows = fragments(result).filter("reasons = 0")
    header = F.concat("r1_header", F.lit("|segment="), F.col("segment_index"), F.lit("|span="), F.col("cut_start"), F.lit("-"), F.col("cut_end")) if has.headers else None
    return rows.select("record_index", "segment_index", F.col("seq").alias("r1_seq"), *[F.col("qual").alias("r1_qual")] * has.quality, *([header.alias("r1_header")] if has.headers else []), *["flag"] * has.flags)


def sidecar(result: DataFrame) -> DataFrame:
    """Every fragment, PASS or FAIL; coordinates are after trimming."""
    has = Presence.of(result)
    header = escaped(F.col("r1_header")) if has.headers else F.lit(".")
    dot = lambda c: F.coalesce(F.col(c), F.lit(".")).alias(c)
    return fragments(result).select(
        F.col("record_index").alias("source_record_index"), "segment_index", F.lit("R1").alias("source_mate"), "start", "end", (F.col("end") - F.col("start")).alias("length"), dot("left_adapter"), dot("right_adapter"),
        header.alias("original_header"), F.when(F.col("reasons") == 0, "PASS").otherwise("FAIL").alias("status"), reason_label(F.col("reasons")).alias("filter_reasons"),
    )


def reason_rows(result: DataFrame) -> DataFrame:
    """Failed fragments in the shape of the reason sidecar."""
    cut = F.col("cut_end") - F.col("cut_start")
    return fragments(result).filter("reasons <> 0").select(
        "record_index", F.concat(F.lit("segment"), F.col("segment_index")).alias("mate"), F.lit("FAIL").alias("status"), reason_label(F.col("reasons")).alias("reasons"),
        cut.alias("original_length"), cut.alias("adapter_trimmed_length"), (F.col("end") - F.col("start")).alias("final_length"), F.lit(".").alias("adapter_name"), F.lit(".").alias("adapter_start"),
    )


def stats(result: DataFrame) -> DataFrame:
    """One row: counters of the cuts, and lengths of fragments before trimming."""
    per = result.select("cuts.*", F.transform("fragments", lambda x: x["cut_end"] - x["cut_start"]).alias("sizes"), F.transform("fragments", lambda x: x["reasons"]).alias("bits"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    n = F.size("sizes")
    return per.agg(
        F.count("*").alias("records"), total("candidates").alias("candidates"), total("delimiters").alias("delimiters"), total(F.col("candidates") - F.col("delimiters")).alias("suppressed"),
        total("empty").alias("empty"), total("terminal").alias("terminal_discarded"), total("short").alias("too_short"), total("over_limit").alias("over_limit"), total(n).alias("fragments"),
        total(F.size(F.filter("bits", lambda b: b != 0))).alias("fragments_failed"), F.min(F.array_min("sizes")).alias("length_min"), F.max(F.array_max("sizes")).alias("length_max"),
        total(F.aggregate("sizes", F.lit(0), lambda a, x: a + x)).alias("length_sum"),
    )


def per_source(result: DataFrame) -> DataFrame:
    """Reads by the number of their fragments."""
    return result.groupBy(F.size("fragments").alias("fragments")).agg(F.count("*").alias("records"))


def delimiter_hits(result: DataFrame, plan: SegmentPlan) -> DataFrame:
    """Delimiters kept, by declared name; those never seen too."""
    names = F.array(*[F.lit(a.name) for a in plan.delimiters])
    sums = [F.coalesce(F.sum(F.get("cuts.hits", F.lit(k))), F.lit(0)).cast("bigint") for k in range(len(plan.delimiters))]
    return result.agg(F.array(*sums).alias("n")).select(F.inline(F.arrays_zip(names.alias("delimiter"), F.col("n").alias("hits"))))
