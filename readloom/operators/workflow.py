"""The fused run: every stage of a plan in one Arrow pass, routing and reports in Catalyst."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom import ship
from readloom.functions.umi import with_umi
from readloom.kernels import bytes as kb
from readloom.kernels import match as km
from readloom.kernels import pair as kp
from readloom.kernels import trim as kt
from readloom.plans.config import Plan
from readloom.schema import Presence

#: Facts of a mate, after the stages.
MATE = (
    "original_length int, adapter_trimmed_length int, start int, end int, adapter int, adapter_start int, adapter_errors int, overlap_removed int, "
    "linked string, linked_which int, linked_five boolean, linked_three boolean, linked_leading int, linked_trailing int, removed array<int>, reasons int, seq string, qual string"
)
EDIT = "mate int, position int, donor_position int, original string, corrected string, original_phred int, corrected_phred int"
OVERLAP = f"offset int, length int, mismatches int, insert int, corrected_r1 int, corrected_r2 int, unresolved int, noncanonical int, edits array<struct<{', '.join(x.replace(' ', ':', 1) for x in EDIT.split(', '))}>>"


def _struct(spec: str) -> str:
    return "struct<" + ", ".join(x.replace(" ", ":", 1) for x in spec.split(", ")) + ">"


def run(reads: DataFrame, plan: Plan) -> DataFrame:
    """`reads` and the facts of the plan: columns r1, r2 (structs, r2 null for single-end), overlap and disposition.

    Nothing is dropped and nothing is shuffled; `route` and the sinks choose from it.
    """
    ship.ensure(reads.sparkSession)
    has = Presence.of(reads)
    plan.validate(has.paired, has.quality, has.headers)
    work = with_umi(reads, plan.umi, has) if plan.umi else reads
    kept = work.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema)
    schema = f"{fields}, r1 {_struct(MATE)}, r2 {_struct(MATE)}, overlap {_struct(OVERLAP)}"
    out = work.mapInArrow(_kernel(plan, has, kept, _arrow_types()), schema)
    return out.withColumn("disposition", disposition(plan.pair_policy, has.paired))


def accepted(reads: DataFrame, plan: Plan) -> DataFrame:
    """What outputs.accepted(run(reads, plan)) gives, in one pass that returns nothing else from the kernels."""
    ship.ensure(reads.sparkSession)
    has = Presence.of(reads)
    plan.validate(has.paired, has.quality, has.headers)
    work = with_umi(reads, plan.umi, has) if plan.umi else reads
    tagged = {m: f"r{m}_tagged" if f"r{m}_tagged" in work.columns else f"r{m}_header" for m in has.mates}
    clips = [c for c in work.columns if c.startswith("umi_clip_r")]
    used = [*dict.fromkeys(["record_index", *has.columns(), *(tagged.values() if has.headers else ()), *clips])]
    work = work.select(*used)
    kinds = dict(work.dtypes)
    out = [("record_index", kinds["record_index"])]
    for m in has.mates:
        out += [(f"r{m}_seq", "string"), *[(f"r{m}_qual", "string")] * has.quality, *[(f"r{m}_header", "string")] * has.headers]
    out += [("flag", kinds["flag"])] if has.flags else []
    types = _arrow_types()

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, has):
                mates = process(piece, plan, has, types)[: len(has.mates)]
                fields = {m: dict(zip([f.name for f in x.type], x.flatten(), strict=True)) for m, x in zip(has.mates, mates, strict=True)}
                ok = np.logical_and.reduce([np.asarray(f["reasons"]) == 0 for f in fields.values()])
                columns = [piece.column("record_index")]
                for m, f in fields.items():
                    columns += [f["seq"], *[f["qual"]] * has.quality, *[piece.column(tagged[m]) for _ in range(has.headers)]]
                columns += [piece.column("flag")] if has.flags else []
                whole = pa.RecordBatch.from_arrays(columns, [n for n, _ in out])
                yield whole if ok.all() else whole.filter(pa.array(ok))

    return work.mapInArrow(run_batches, ", ".join(f"`{n}` {t}" for n, t in out))


def disposition(policy: str, paired: bool) -> Column:
    """Both mates pass: accepted; both fail: rejected; one fails: rejected, or by the orphan policy the other's orphan."""
    ok1 = F.col("r1.reasons") == 0
    if not paired:
        return F.when(ok1, "accepted").otherwise("rejected")
    ok2 = F.col("r2.reasons") == 0
    out = F.when(ok1 & ok2, "accepted")
    if policy == "orphan":
        out = out.when(ok1, "orphan_r1").when(ok2, "orphan_r2")
    return out.otherwise("rejected")


def _arrow_types() -> tuple[pa.DataType, pa.DataType]:
    kind = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    parse = lambda spec: [(x.split(" ")[0], x.split(" ")[1]) for x in spec.split(", ")]
    mate = pa.struct([(n, kind[t]) for n, t in parse(MATE)])
    edit = pa.struct([(n, kind[t]) for n, t in parse(EDIT)])
    head = [(n, kind[t]) for n, t in parse(OVERLAP.split(", edits")[0])]
    return mate, pa.struct([*head, ("edits", pa.list_(edit))])


def _kernel(plan: Plan, has: Presence, kept: list[str], types: tuple[pa.DataType, pa.DataType]):
    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, has):
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], *process(piece, plan, has, types)], [*kept, "r1", "r2", "overlap"])

    return run_batches


def _pieces(batch: pa.RecordBatch, has: Presence) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, so many that their matrices stay bounded."""
    sizes = [np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(f"r{m}_seq")), 0)) for m in has.mates]
    for part in kb.parts(sizes, batch.num_rows):
        yield batch.slice(part.start, part.stop - part.start)


def _clip(batch: pa.RecordBatch, mate: int) -> np.ndarray:
    name = f"umi_clip_r{mate}"
    return np.asarray(batch.column(name), np.int64) if name in batch.schema.names else np.zeros(batch.num_rows, np.int64)


def _load(batch: pa.RecordBatch, mate: int, need_quality: bool, has: Presence) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """(bases, qualities or None, lengths, clip) behind the UMI."""
    m, length = kb.matrix(batch.column(f"r{mate}_seq"))
    q = None
    if has.quality:
        q, qlength = kb.matrix(batch.column(f"r{mate}_qual"))
        if (qlength != length).any():
            raise ValueError(f"R{mate}: sequence and quality differ in length")
        if need_quality:
            inside = np.arange(q.shape[1]) < length[:, None]
            bad = inside & ((q < 33) | (q > 126))
            if bad.any():
                row = int(bad.any(1).argmax())
                raise ValueError(f"record {batch.column('record_index')[row]}, R{mate}: quality byte {int(q[row][bad[row]][0])} is outside 33 to 126")
    clip = _clip(batch, mate)
    if clip.any():
        m, q, length = kb.shift(m, clip), kb.shift(q, clip) if q is not None else None, length - clip
    return m, q, length, clip


def process(batch: pa.RecordBatch, plan: Plan, has: Presence, types: tuple[pa.DataType, pa.DataType]) -> list[pa.Array]:
    """Facts of one batch: r1, r2 and overlap as struct arrays."""
    n = batch.num_rows
    sides = {1: _load(batch, 1, plan.needs_quality, has)} | ({2: _load(batch, 2, plan.needs_quality, has)} if has.paired else {})
    over_array, insert, found = pa.nulls(n, types[1]), np.zeros(n, np.int64), np.zeros(n, bool)
    if has.paired and plan.needs_overlap:
        (m1, q1, len1, c1), (m2, q2, len2, c2) = sides[1], sides[2]
        over = kp.overlap(m1, len1, m2, len2, plan.overlap)
        edits = None
        if plan.correction:
            edits = kp.correct(m1, q1, len1, m2, q2, len2, over, plan.correction)
            m1, q1, m2, q2 = kp.apply(m1, q1, m2, q2, edits)
            sides = {1: (m1, q1, len1, c1), 2: (m2, q2, len2, c2)}
        over_array = _overlap_array(over, edits, n, types[1])
        if plan.adapter and plan.adapter.paired_overlap:
            insert, found = over.insert, over.found
    out = [_mate(sides[k], k, plan, found, insert, types[0]) if k in sides else pa.nulls(n, types[0]) for k in (1, 2)]
    return [*out, over_array]


def _mate(side, mate: int, plan: Plan, by_overlap: np.ndarray, insert: np.ndarray, kind: pa.DataType) -> pa.Array:
    m, q, length, clip = side
    n = len(length)
    s, e = np.zeros(n, np.int64), length.copy()
    skip = np.zeros(n, bool)
    bits = np.zeros(n, np.int64)
    linked = None
    if plan.linked:
        linked = km.linked(m, length, list(getattr(plan.linked, f"r{mate}")), plan.match, plan.linked.options)
        matched = linked.status == km.MATCHED
        s, e = np.where(matched, linked.start, s), np.where(matched, linked.end, e)
        skip = matched if plan.linked.unmatched == "continue" else np.ones(n, bool)
        if plan.linked.unmatched == "fail":
            bits[~matched] |= 1 << 6
    leading, trailing = s, length - e
    overlap_removed = np.zeros(n, np.int64)
    hits = km.Hits.none(n)
    if plan.adapter:
        cut = ~skip & by_overlap
        overlap_removed = np.where(cut, np.maximum(e - s - insert, 0), 0)
        e = e - overlap_removed
        todo = np.flatnonzero(~skip & ~by_overlap)
        names = [a.sequence for a in getattr(plan.adapter, f"r{mate}")]
        if names and len(todo):
            some = km.three_prime(m[todo], length[todo], names, plan.match) if len(todo) < n else km.three_prime(m, length, names, plan.match)
            hits.put(todo, some.start, some.errors, some.overlap, some.consumed, some.which)
            e = np.where(hits.start >= 0, hits.start, e)
    trimmed_length = e - s
    removed = np.zeros((n, len(kt.OPS)), np.int64)
    if plan.trim:
        s, e, removed = kt.trim(m, q, s, e, plan.trim[mate - 1])
    if plan.filter:
        bits |= kt.reasons(m, q, s, e, plan.filter)
    i32 = lambda x, null=None: pa.array(x.astype(np.int32), mask=null)
    none = pa.nulls(n, pa.int32())
    no_hit = hits.which < 0
    labels = pa.array(np.array(km.LINKED_LABELS, object)[linked.status], pa.string()) if linked else pa.nulls(n, pa.string())
    not_matched = linked.which < 0 if linked else None
    removed_list = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(kt.OPS)), i32(removed.ravel()))
    columns = [
        i32(length + clip), i32(trimmed_length + clip), i32(s), i32(e), i32(hits.which, no_hit), i32(hits.start, no_hit), i32(hits.errors, no_hit), i32(overlap_removed),
        labels, i32(linked.which, not_matched) if linked else none, pa.array(linked.five) if linked else pa.nulls(n, pa.bool_()), pa.array(linked.three) if linked else pa.nulls(n, pa.bool_()), i32(leading), i32(trailing),
        removed_list, i32(bits), kb.strings(m, s, e), kb.strings(q, s, e) if q is not None else pa.nulls(n, pa.string()),
    ]
    return pa.StructArray.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, kind, strict=True)], fields=list(kind))


def _overlap_array(over: kp.Overlap, edits: kp.Edits | None, n: int, kind: pa.DataType) -> pa.Array:
    i32 = lambda x: pa.array(x.astype(np.int32))
    zero = np.zeros(n, np.int64)
    edit_kind = kind.field("edits").type.value_type
    if edits is None:
        lists = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], edit_kind))
        counts = [zero] * 4
    else:
        base = lambda x: pa.array([chr(b) for b in x.tolist()], pa.string())
        values = pa.StructArray.from_arrays([i32(edits.mate), i32(edits.position), i32(edits.donor_position), base(edits.original), base(edits.corrected), i32(edits.original_quality), i32(edits.corrected_quality)], fields=list(edit_kind))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(edits.row, np.arange(n + 1)).astype(np.int32)), values)
        counts = [edits.corrected_r1, edits.corrected_r2, edits.unresolved, edits.noncanonical]
    columns = [i32(over.offset), i32(over.length), i32(over.mismatches), i32(over.insert), *map(i32, counts), lists]
    return pa.StructArray.from_arrays(columns, fields=list(kind), mask=pa.array(~over.found))


def reason_label(bits: Column) -> Column:
    """Reasons joined by / in bit order, PASS if there is none."""
    names = [F.when(bits.bitwiseAND(1 << k) != 0, F.lit(name)) for k, name in enumerate(kt.REASONS)]
    return F.coalesce(F.nullif(F.concat_ws("/", *names), F.lit("")), F.lit("PASS"))
