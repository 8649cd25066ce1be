"""Command line: adapter, trim, filter, correct, umi, workflow, dedup, segment, sniff-adapters, sniff-strand.

Options are those of the stages' parameters, --<stage>-<field>; a TOML file gives the same, and options go before it.
Exit codes: 0 done, 2 wrong options, 3 not certain where certainty is required.
"""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from readloom import reporting, sinks
from readloom.kernels.match import LinkedParams, MatchParams
from readloom.kernels.pair import CorrectionParams, OverlapParams
from readloom.kernels.segment import SegmentParams
from readloom.kernels.trim import FilterParams, TrimParams
from readloom.operators import dedup, outputs, segment, sniff, strand, workflow
from readloom.operators.sample import sample
from readloom.plans.config import Adapter, Plan, SegmentPlan, UmiStage, load_toml, merge, plan_from
from readloom.sources import catalogue
from readloom.sources import reads as source

STAGES = {"adapter": MatchParams, "trim": TrimParams, "filter": FilterParams, "umi": UmiStage, "correction": CorrectionParams, "overlap": OverlapParams, "linked": LinkedParams}
COMMANDS = {"adapter": ("adapter", "overlap", "linked"), "trim": ("trim",), "filter": ("filter",), "correct": ("correction", "overlap"), "umi": ("umi",), "workflow": tuple(STAGES)}


def _add(parser: argparse.ArgumentParser, stage: str, kind: type) -> None:
    for f in fields(kind):
        text = str(f.type)
        how: dict[str, Any] = {"action": argparse.BooleanOptionalAction} if text == "bool" else {"type": int if text.startswith("int") else float if text.startswith("float") else str}
        parser.add_argument(f"--{stage}-{f.name.replace('_', '-')}", dest=f"{stage}.{f.name}", default=None, **how)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("readloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in (*COMMANDS, "dedup", "segment", "sniff-adapters", "sniff-strand"):
        p = sub.add_parser(name)
        p.add_argument("input")
        p.add_argument("-o", "--output", required=not name.startswith("sniff"))
        p.add_argument("--force", action="store_true")
        p.add_argument("--span", help="START..END, either may be missing")
        p.add_argument("--report")
        p.add_argument("--report-format", choices=("json", "tsv"), default="json")
        p.add_argument("-q", "--quiet", action="store_true")
        p.add_argument("--partitions", type=int, help="partitions of a shuffle")
        p.add_argument("--batch-rows", type=int, help="records that a kernel is given at once")
        p.add_argument("--compression", default="zstd")
        p.add_argument("--compression-level", type=int)
        p.add_argument("--block-size", type=int)
        p.add_argument("--unsorted", action="store_true", help="leave records as tasks give them")
        if name in COMMANDS:
            p.add_argument("--config")
            p.add_argument("--steps", help="stages to run, comma-separated")
            for stage in ("adapter", "trim", "filter"):
                p.add_argument(f"--no-{stage}", dest="without", action="append_const", const=stage)
            for stage in COMMANDS[name]:
                _add(p, stage, STAGES[stage])
            for mate in ("r1", "r2"):
                p.add_argument(f"--adapter-{mate}", action="append", default=[])
                p.add_argument(f"--adapter-fasta-{mate}")
                p.add_argument(f"--linked-5p-{mate}", dest=f"five_{mate}", action="append", default=[])
                p.add_argument(f"--linked-3p-{mate}", dest=f"three_{mate}", action="append", default=[])
            p.add_argument("--linked-unmatched", choices=("continue", "keep", "fail"))
            p.add_argument("--paired-overlap", action="store_true")
            p.add_argument("--correction", action="store_true")
            p.add_argument("--auto-detect", action="store_true")
            p.add_argument("--pair-policy", choices=("strict", "orphan"))
            p.add_argument("--orphan-prefix")
            p.add_argument("--failed")
            p.add_argument("--failed-mode", choices=("original", "processed"), default="original")
            p.add_argument("--failed-reasons")
            p.add_argument("--correction-log")
            p.add_argument("--correction-log-detail", choices=("reads", "bases"), default="reads")
        elif name == "segment":
            p.add_argument("--delimiter", action="append", default=[], required=True)
            p.add_argument("--segments")
            p.add_argument("--failed-reasons")
            for stage, kind in (("match", MatchParams), ("segment", SegmentParams), ("trim", TrimParams), ("filter", FilterParams)):
                _add(p, stage, kind)
        elif name == "sniff-adapters":
            p.add_argument("--sample", type=int, default=262_144)
            p.add_argument("--top", type=int, default=5)
            p.add_argument("--catalogue", help="CSV (name, r1, r2) or FASTA instead of the known sequences")
            p.add_argument("--format", choices=("json", "tsv", "text"), default="json")
            p.add_argument("--emit-config")
            p.add_argument("--require-confident", action="store_true")
            _add(p, "match", MatchParams)
        elif name == "sniff-strand":
            p.add_argument("--transcriptome", help="FASTA or a table")
            p.add_argument("--decoys", help="a text file of names of decoys")
            p.add_argument("--index", help="a stored index; made there first if a transcriptome is given too")
            p.add_argument("--sample", type=int, default=262_144)
            p.add_argument("--format", choices=("json", "tsv", "text"), default="json")
            _add(p, "strand", strand.StrandParams)
    return top


def _fields(args: argparse.Namespace, stage: str) -> dict[str, Any]:
    return {k.split(".", 1)[1]: v for k, v in vars(args).items() if k.startswith(f"{stage}.") and v is not None}


def _span(args: argparse.Namespace) -> tuple[int, int | None]:
    if not args.span:
        return 0, None
    start, dots, end = args.span.partition("..")
    if not dots:
        raise ValueError("--span is START..END")
    return int(start or 0), int(end) if end else None


def options(args: argparse.Namespace) -> dict[str, Any]:
    """The TOML file's options under those of the command line."""
    out: dict[str, Any] = {}
    for stage in COMMANDS[args.command]:
        own = _fields(args, stage)
        if own and stage != "linked":  # thresholds of flanks alone say nothing
            out[stage] = own
    for mate in ("r1", "r2"):
        declared: list[Any] = list(getattr(args, f"adapter_{mate}"))
        if path := getattr(args, f"adapter_fasta_{mate}"):
            declared += [{"name": a.name, "sequence": a.sequence} for a in catalogue.read_fasta(path)]
        if declared:
            out.setdefault("adapter", {})[mate] = declared
        five, three = getattr(args, f"five_{mate}"), getattr(args, f"three_{mate}")
        if len(five) != len(three):
            raise ValueError("a linked definition needs both flanks")
        if five:
            out.setdefault("linked", _fields(args, "linked") | ({"unmatched": args.linked_unmatched} if args.linked_unmatched else {}))[mate] = [{"five": a, "three": b} for a, b in zip(five, three, strict=True)]
    if args.paired_overlap:
        out.setdefault("adapter", {})["paired_overlap"] = True
    if (args.correction or args.command == "correct") and "correction" in COMMANDS[args.command]:
        out.setdefault("correction", {})
    if args.pair_policy:
        out["pair_policy"] = args.pair_policy
    return merge(load_toml(args.config), out) if args.config else out


def plan_of(args: argparse.Namespace) -> Plan:
    plan = plan_from(options(args))
    if args.steps:
        plan = plan.only(tuple(s.strip() for s in args.steps.split(",")))
    return plan.without(*args.without) if args.without else plan


def _emit(spark: SparkSession, args: argparse.Namespace, found: dict[str, Any], path: str | None, tsv: str | None = None) -> None:
    text = tsv if tsv is not None else sinks.as_tsv(found) if getattr(args, "format", args.report_format) == "tsv" else sinks.as_json(found)
    if path:
        sinks.write_text(spark, path, text, args.force)
    else:
        print(text)


def _run_stages(spark: SparkSession, args: argparse.Namespace) -> None:
    reads = source.read(spark, args.input, *_span(args))
    plan = plan_of(args)
    if args.auto_detect:
        plan = reporting.with_detected(plan, sniff.sniff(reads, catalogue.load()))
    names = tuple(tuple(a.name for a in side) for side in ((plan.adapter.r1, plan.adapter.r2) if plan.adapter else ((), ())))
    if args.failed and plan.filter is None:
        raise ValueError("--failed needs a filter")
    if plan.pair_policy == "orphan" and not args.orphan_prefix:
        raise ValueError("the orphan policy needs --orphan-prefix")
    if args.correction_log and plan.correction is None:
        raise ValueError("--correction-log needs the correction stage")
    paths = [args.output, args.failed, *([f"{args.orphan_prefix}.R{m}" for m in (1, 2)] if plan.pair_policy == "orphan" else []), args.failed_reasons, args.correction_log, args.report]
    sinks.reserve(spark, [args.input], [p for p in paths if p], args.force)
    began = time.monotonic()

    def finish(result: DataFrame) -> None:
        out = {args.output: outputs.accepted(result)}
        if args.failed:
            out[args.failed] = outputs.failed(result, args.failed_mode)
        if plan.pair_policy == "orphan":
            out |= {f"{args.orphan_prefix}.R{m}": outputs.orphans(result, m) for m in (1, 2)}
        if args.failed_reasons:
            out[args.failed_reasons] = outputs.reason_rows(result, names)
        if args.correction_log:
            out[args.correction_log] = outputs.correction_bases(result) if args.correction_log_detail == "bases" else outputs.correction_reads(result)
        for path, df in out.items():
            _publish(df, path, args, ("record_index", "mate", "read_position"))
        if args.report or not args.quiet:
            found = reporting.run_report(result, plan, [args.input], {str(i): p for i, p in enumerate(out)}, time.monotonic() - began)
            if args.report:
                _emit(spark, args, found, args.report)
            if not args.quiet:
                print(reporting.summary(found), file=sys.stderr)

    if args.quiet and not any(paths[1:]):  # nothing but the accepted records is asked for
        table = workflow.accepted(reads, plan)
        if args.unsorted:
            _publish(table, args.output, args)
        else:  # sorting reads its input twice
            with sinks.staged(table, args.output) as facts:
                _publish(facts, args.output, args)
        return
    with sinks.staged(workflow.run(reads, plan), args.output) as facts:
        finish(facts)


def _publish(df: DataFrame, path: str, args: argparse.Namespace, order: tuple[str, ...] = ("record_index",)) -> None:
    sinks.publish(df, path, args.force, () if args.unsorted else order, args.compression, args.block_size, args.compression_level)


def _run_segment(spark: SparkSession, args: argparse.Namespace) -> None:
    trim, keep = _fields(args, "trim"), _fields(args, "filter")
    plan = SegmentPlan(tuple(Adapter.of(f"delimiter_{i}", d) for i, d in enumerate(args.delimiter)), MatchParams(**_fields(args, "match")), SegmentParams(**_fields(args, "segment")), TrimParams(**trim) if trim else None, FilterParams(**keep) if keep else None)
    reads = source.read(spark, args.input, *_span(args))
    if "r1_header" not in reads.columns and not args.segments:
        raise ValueError("reads without headers need --segments")
    sinks.reserve(spark, [args.input], [p for p in (args.output, args.segments, args.failed_reasons, args.report) if p], args.force)
    with sinks.staged(segment.run(reads, plan), args.output) as result:
        out = {args.output: segment.passed(result)} | ({args.segments: segment.sidecar(result)} if args.segments else {}) | ({args.failed_reasons: segment.reason_rows(result)} if args.failed_reasons else {})
        for path, df in out.items():
            _publish(df, path, args, ("record_index", "source_record_index", "segment_index", "mate"))
        if args.report:
            _emit(spark, args, {"counts": sinks.rows(segment.stats(result))[0], "per_source": sinks.rows(segment.per_source(result)), "hits": sinks.rows(segment.delimiter_hits(result, plan))}, args.report)


def _sniff_strand(spark: SparkSession, args: argparse.Namespace) -> None:
    params = strand.StrandParams(**_fields(args, "strand")).validate()
    if not (args.transcriptome or args.index):
        raise ValueError("sniff-strand needs --transcriptome or --index")
    made = strand.read_transcripts(spark, args.transcriptome, args.decoys) if args.transcriptome else None
    if args.index and made is not None and not sinks.exists(spark, args.index):
        strand.build_index(made, args.index, params.k)
    index = strand.load_index(spark, args.index, params.k) if args.index else strand.kmer_index(made, params.k)
    about = {"path": args.index or args.transcriptome, "k": params.k, "transcripts": index.select("transcript").distinct().count()}
    found = strand.sniff_by(sample(source.read(spark, args.input, *_span(args)), args.sample), index, params)
    whole = reporting.strand_report(found, args.input, params, about)
    _emit(spark, args, whole, args.output, reporting.strand_text(whole) if args.format == "text" else None)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("readloom").getOrCreate()
    try:
        for name, value in (("spark.sql.shuffle.partitions", args.partitions), ("spark.sql.execution.arrow.maxRecordsPerBatch", args.batch_rows)):
            if value is not None:
                if value < 1:
                    raise ValueError("partitions and batch rows must be positive")
                spark.conf.set(name, str(value))
        if args.command in COMMANDS:
            _run_stages(spark, args)
        elif args.command == "segment":
            _run_segment(spark, args)
        elif args.command == "dedup":
            reads = source.read(spark, args.input)
            sinks.reserve(spark, [args.input], [p for p in (args.output, args.report) if p], args.force)
            _publish(dedup.dedup(reads), args.output, args)
            if args.report:
                _emit(spark, args, sinks.rows(dedup.stats(reads))[0], args.report)
        elif args.command == "sniff-adapters":
            params = sniff.SniffParams(args.sample, args.top, MatchParams(**_fields(args, "match")))
            found = sniff.sniff(source.read(spark, args.input, *_span(args)), catalogue.load(args.catalogue), params)
            whole = reporting.adapters_report(found, args.input, params)
            _emit(spark, args, whole, args.output, reporting.adapters_tsv(whole) if args.format == "tsv" else reporting.adapters_text(whole) if args.format == "text" else None)
            if args.emit_config:
                sinks.write_text(spark, args.emit_config, reporting.config_toml(found), args.force)
            if args.require_confident and found.decision != "confident":
                return 3
        else:
            _sniff_strand(spark, args)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
