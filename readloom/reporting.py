"""Reports as nested dictionaries, and what the sniffers found as text, JSON, TSV or a configuration."""

from __future__ import annotations

from dataclasses import asdict, replace
from typing import Any

from pyspark.sql import DataFrame

from readloom import __version__
from readloom.operators import report, sniff, strand
from readloom.plans.config import Adapter, AdapterStage, Plan, check
from readloom.sinks import rows


def run_report(result: DataFrame, plan: Plan, inputs: list[str], outputs: dict[str, str], seconds: float | None = None) -> dict[str, Any]:
    """Counts of a run, and its speed if it took `seconds`; sections of stages that did not run are null."""
    paired = "r2_seq" in result.columns
    names = tuple(tuple(a.name for a in side) for side in (plan.adapter.r1, plan.adapter.r2)) if plan.adapter else ((), ())
    section = lambda on, make: make() if on else None
    counts = rows(report.counts(result))[0]
    return {
        "tool": {"name": "readloom", "version": __version__},
        "input": inputs,
        "config": asdict(plan),
        "outputs": outputs,
        "counts": counts,
        "umi": section(plan.umi, lambda: rows(report.umi(result))[0]),
        "correction": section(plan.correction and paired, lambda: rows(report.correction(result))[0] | {"substitutions": rows(report.substitutions(result)), "per_pair": rows(report.corrections_per_pair(result))}),
        "linked": section(plan.linked, lambda: rows(report.linked(result))),
        "adapter": section(plan.adapter, lambda: {"mates": rows(report.adapters(result)), "hits": rows(report.adapter_hits(result, names)) if any(names) else []}),
        "trim": section(plan.trim, lambda: rows(report.trims(result, plan.trim))),
        "filter": section(plan.filter, lambda: {"reasons": rows(report.reasons(result)), "combinations": rows(report.combinations(result))}),
        "performance": section(seconds, lambda: performance(counts, seconds)),
    }


def performance(counts: dict[str, Any], seconds: float) -> dict[str, Any]:
    bases = sum(counts.get(f"bases_in_r{m}", 0) for m in (1, 2))
    return {"seconds": round(seconds, 3), "records_per_second": round(counts["records_in"] / seconds, 1), "bases_per_second": round(bases / seconds, 1)}


def _lines(value: dict[str, Any]) -> list[str]:
    """Names and numbers, one a line."""
    out = []
    for name, x in value.items():
        if isinstance(x, list):
            out += [f"  {' '.join(str(v) for v in row.values() if isinstance(v, str))}: {', '.join(f'{k} {v:,}' for k, v in row.items() if isinstance(v, int))}" for row in x]
        else:
            out.append(f"  {name.replace('_', ' ')} {x:,}" if isinstance(x, (int, float)) else f"  {name.replace('_', ' ')} {x}")
    return out


def summary(found: dict[str, Any]) -> str:
    """A few lines a section for a terminal; a section without a stage is left out."""
    c = found["counts"]
    share = f" ({c['records_out'] / c['records_in']:.2%})" if c["records_in"] else ""
    lines = ["Input", f"  records {c['records_in']:,}", *[f"  bases R{m} {c[f'bases_in_r{m}']:,}" for m in (1, 2) if f"bases_in_r{m}" in c]]
    lines += ["Output", f"  accepted {c['records_out']:,}{share}", f"  rejected {c['records_rejected']:,}", *[f"  bases R{m} {c[f'bases_out_r{m}']:,}" for m in (1, 2) if f"bases_out_r{m}" in c]]
    lines += [f"  orphans R{m} {c[f'orphaned_r{m}']:,}" for m in (1, 2) if c.get(f"orphaned_r{m}")]
    for name in ("umi", "correction", "linked", "adapter", "trim", "filter", "segments", "performance"):
        if found.get(name) is not None:
            value = found[name]
            lines += [name.capitalize(), *_lines(value if isinstance(value, dict) else {name: value})]
    return "\n".join(lines) + "\n"


SCHEMA_VERSION = 1
TSV_COLUMNS = (
    "input", "mate", "decision", "sequence", "known_name", "known_category", "confidence", "evidence_sources", "supporting_reads", "support_fraction", "tail_connected_fraction", "tail_enrichment",
    "median_start", "median_distance_to_end", "exact_matches", "substitution_matches", "indel_matches", "mean_error_rate", "paired_overlap_support",
)


def _candidate(c: sniff.Candidate) -> dict[str, Any]:
    return {
        "sequence": c.sequence, "known_name": c.known_name, "known_category": c.known_category, "confidence": c.confidence, "evidence_sources": list(c.sources), "supporting_reads": c.supporting, "support_fraction": c.support_fraction,
        "tail_connected_fraction": c.tail_connected, "tail_enrichment": c.enrichment, "median_start": c.median_start, "median_distance_to_end": c.median_to_end, "exact_matches": c.exact, "substitution_matches": c.substitution,
        "indel_matches": c.indel, "mean_error_rate": c.mean_error, "paired_overlap_support": c.overlap_support,
    }


def adapters_report(found: sniff.AdapterReport, path: str, params: sniff.SniffParams) -> dict[str, Any]:
    mates = [{"mate": m.mate, "decision": m.decision, "recommended_sequence": m.recommended.sequence if m.recommended else None, "recommended_name": m.recommended.known_name if m.recommended else None, "sampled_reads": m.sampled, "informative_reads": m.informative, "poly_a": m.poly_a, "poly_g": m.poly_g, "candidates": [_candidate(c) for c in m.candidates]} for m in found.mates]
    return {"schema_version": SCHEMA_VERSION, "command": "sniff adapters", "tool": {"name": "readloom", "version": __version__}, "input": path, "sample": found.sampled, "parameters": asdict(params), "result": {"decision": found.decision, "mates": mates}, "warnings": found.warnings}


_ZEROS = frozenset(TSV_COLUMNS[8:]) - {"tail_enrichment"}
_SHARES = frozenset({"support_fraction", "tail_connected_fraction", "mean_error_rate"})


def adapters_tsv(found: dict[str, Any]) -> str:
    """A row for each candidate, and one for a mate without any; shares have six places, and what is missing is a point."""
    out = ["\t".join(TSV_COLUMNS)]
    for m in found["result"]["mates"]:
        for c in m["candidates"] or [None]:
            row = {"input": found["input"], "mate": m["mate"], "decision": m["decision"]} | (c or dict.fromkeys(_ZEROS, 0))

            def text(k: str, row: dict[str, Any] = row, has: bool = c is not None) -> str:
                v = row.get(k)
                return "." if v is None else ",".join(v) if isinstance(v, list) else f"{v:.6f}" if has and (k in _SHARES or k == "tail_enrichment") else str(v)

            out.append("\t".join(map(text, TSV_COLUMNS)))
    return "\n".join(out) + "\n"


def adapters_text(found: dict[str, Any]) -> str:
    """The report for a reader."""
    out = [f"Input: {found['input']}", f"Records sampled: {found['sample']:,}", "Sampling: evenly spaced"]
    for m in found["result"]["mates"]:
        out += ["", f"{m['mate']} adapter result: {m['decision']}"]
        out += [] if m["candidates"] else ["  No candidate found."]
        for c in m["candidates"]:
            enriched = c["tail_enrichment"]
            out += [f"  Sequence: {c['sequence']}", *([f"  Known as: {c['known_name']}", f"  Category: {c['known_category']}"] if c["known_name"] else []), f"  Confidence: {c['confidence']}"]
            out += [f"  Supporting reads: {c['supporting_reads']:,} ({c['support_fraction']:.2%})", f"  3' connected matches: {c['tail_connected_fraction']:.1%}", f"  Tail enrichment: {'only in tails' if enriched is None else f'{enriched:.1f}x'}", f"  Evidence: {', '.join(c['evidence_sources'])}"]
        if m["poly_a"] or m["poly_g"]:
            out.append(f"  Artifact signal: {m['poly_a']:,} poly-A, {m['poly_g']:,} poly-G reads")
    return "\n".join([*out, *(f"\nWarning: {w}" for w in found["warnings"])]) + "\n"


def strand_text(found: dict[str, Any]) -> str:
    r = found["result"]
    out = [f"Input: {found['input']}", f"Decision: {r['decision']}", f"Strandedness: {r['strandedness']}", f"Library type: {r['library_type'] or 'undetermined'}", f"Pair orientation: {r['orientation']}"]
    out += [f"Records examined: {r['examined']:,}", f"Informative: {r['informative']:,}", f"Ambiguous: {r['ambiguous']:,}", f"Only on decoys: {r['decoy_only']:,}", f"Forward: {r['forward_fraction']:.2%}", f"Reverse: {r['reverse_fraction']:.2%}"]
    if r["featurecounts_strand"] is not None:
        out += [f"featureCounts -s {r['featurecounts_strand']}", f"htseq-count --stranded {r['htseq_stranded']}"]
    return "\n".join([*out, *(f"Warning: {w}" for w in found["warnings"])]) + "\n"


def strand_report(found: strand.StrandReport, path: str, params: strand.StrandParams, index: dict[str, Any] | None = None) -> dict[str, Any]:
    return {"schema_version": SCHEMA_VERSION, "command": "sniff strand", "tool": {"name": "readloom", "version": __version__}, "input": path, "index": index, "parameters": asdict(params), "result": asdict(found) | {"featurecounts_strand": found.featurecounts, "htseq_stranded": found.htseq}, "warnings": found.warnings}


def config_toml(found: sniff.AdapterReport) -> str:
    """An [adapter] table of what is recommended; an error unless the decision is confident for every mate."""
    check(found.decision == "confident" and all(m.recommended for m in found.mates), "the adapters are not certain enough to write a configuration")
    return "[adapter]\n" + "".join(f'{m.mate.lower()} = ["{m.recommended.sequence}"]\n' for m in found.mates)


def with_detected(plan: Plan, found: sniff.AdapterReport) -> Plan:
    """The plan with the best certain candidate of each mate appended; without any it stays as it is."""
    stage = plan.adapter or AdapterStage()
    sides = {"R1": stage.r1, "R2": stage.r2}
    for m in found.mates:
        if m.recommended:
            sides[m.mate] = (*sides[m.mate], Adapter.of(m.recommended.known_name or f"detected_{m.mate}", m.recommended.sequence))
    if not (sides["R1"] or sides["R2"]):
        return plan
    return replace(plan, adapter=replace(stage, r1=sides["R1"], r2=sides["R2"]))
