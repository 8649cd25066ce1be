"""What to run: validated, immutable stage options. Wrong ones are ValueErrors before any job starts."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from readloom.kernels.match import Linked, LinkedParams, MatchParams
from readloom.kernels.pair import CorrectionParams, OverlapParams
from readloom.kernels.segment import SegmentParams
from readloom.kernels.trim import FilterParams, TrimParams

BASES = frozenset("ACGTN")
UMI_LOCATIONS = ("read1", "read2", "per_read", "index1", "index2", "per_index")


def check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class Adapter:
    name: str
    sequence: str

    @classmethod
    def of(cls, name: str, sequence: str) -> Adapter:
        """Upper-cased; any symbol outside ACGTN is an error that names its place."""
        upper = sequence.upper()
        check(bool(upper), f"adapter {name}: empty sequence")
        for i, base in enumerate(upper, 1):
            check(base in BASES, f"adapter {name}: symbol {base!r} at position {i}")
        return cls(name, upper)


@dataclass(frozen=True)
class AdapterStage:
    r1: tuple[Adapter, ...] = ()
    r2: tuple[Adapter, ...] = ()
    match: MatchParams = MatchParams()
    paired_overlap: bool = False

    def validate(self, paired: bool) -> None:
        check(bool(self.r1 or self.r2 or self.paired_overlap), "the adapter stage needs an adapter or the paired overlap")
        check(paired or not (self.r2 or self.paired_overlap), "R2 adapters and the paired overlap need paired reads")
        validate_match(self.match, [*self.r1, *self.r2])


def validate_match(p: MatchParams, adapters: list[Adapter] | tuple[Adapter, ...]) -> None:
    check(p.min_overlap >= 1, "min_overlap must be at least 1")
    check(0 <= p.max_error_rate <= 1, "max_error_rate must be within 0 and 1")
    for a in adapters:
        check(len(a.sequence) >= p.min_overlap, f"adapter {a.name} is shorter than min_overlap")


@dataclass(frozen=True)
class LinkedStage:
    r1: tuple[Linked, ...] = ()
    r2: tuple[Linked, ...] = ()
    options: LinkedParams = LinkedParams()
    unmatched: str = "continue"  # or keep, fail

    def validate(self, paired: bool) -> None:
        check(bool(self.r1 or self.r2), "linked flanks need a definition")
        check(paired or not self.r2, "R2 flanks need paired reads")
        check(all(d.five and d.three for d in (*self.r1, *self.r2)), "a linked definition needs both flanks")
        check(self.options.require in ("both", "either"), "require is both or either")
        check(self.unmatched in ("continue", "keep", "fail"), "unmatched is continue, keep or fail")


@dataclass(frozen=True)
class UmiStage:
    location: str = "read1"
    length: int = 0
    skip: int = 0
    prefix: str = ""
    delimiter: str = ":"

    def validate(self, paired: bool, headers: bool) -> None:
        check(self.location in UMI_LOCATIONS, f"umi location is one of {', '.join(UMI_LOCATIONS)}")
        check(headers, "UMI tags need stored headers")
        check(paired or self.location in ("read1", "index1"), f"umi location {self.location} needs paired reads")
        check(self.length > 0 or self.location in ("index1", "index2", "per_index"), "umi length must be positive")


@dataclass(frozen=True)
class Plan:
    """A run: any of the stages, always in the order umi, correct, linked, adapter, trim, filter."""

    umi: UmiStage | None = None
    correction: CorrectionParams | None = None
    overlap: OverlapParams = field(default_factory=OverlapParams)
    linked: LinkedStage | None = None
    adapter: AdapterStage | None = None
    trim: tuple[TrimParams, TrimParams] | None = None  # of R1 and R2
    filter: FilterParams | None = None
    pair_policy: str = "strict"  # or orphan

    @property
    def stages(self) -> tuple[str, ...]:
        return tuple(s for s in ("umi", "correction", "linked", "adapter", "trim", "filter") if getattr(self, s) is not None)

    @property
    def needs_overlap(self) -> bool:
        return self.correction is not None or self.adapter is not None and self.adapter.paired_overlap

    @property
    def needs_quality(self) -> bool:
        return self.correction is not None or self.trim is not None and any(t.needs_quality for t in self.trim) or self.filter is not None and self.filter.needs_quality

    @property
    def match(self) -> MatchParams:
        return self.adapter.match if self.adapter else MatchParams()

    def validate(self, paired: bool, quality: bool, headers: bool) -> Plan:
        check(bool(self.stages), "no stage is configured")
        check(quality or not self.needs_quality, "a stage needs qualities that the input does not have")
        check(self.pair_policy in ("strict", "orphan"), "pair_policy is strict or orphan")
        check(self.pair_policy == "strict" or paired and self.filter is not None, "orphans need paired reads and a filter")
        if self.umi:
            self.umi.validate(paired, headers)
        if self.correction:
            check(paired, "correction needs paired reads")
            check(self.correction.donor > self.correction.recipient, "the donor's quality must be above the recipient's")
        if self.needs_overlap:
            check(self.overlap.min_overlap >= 1 and 0 <= self.overlap.max_error_rate <= 1, "overlap parameters are out of range")
        if self.linked:
            self.linked.validate(paired)
        if self.adapter:
            self.adapter.validate(paired)
        for t in self.trim or ():
            validate_trim(t)
        if self.trim:
            check(any(t != TrimParams() for t in self.trim), "the trim stage does nothing")
        if self.filter:
            validate_filter(self.filter)
        return self

    def only(self, steps: tuple[str, ...]) -> Plan:
        """The named stages; each must be configured."""
        check(bool(steps), "no stage is left")
        for s in steps:
            check(s in self.stages, f"stage {s} is not configured")
        return replace(self, **{s: None for s in self.stages if s not in steps})

    def without(self, *steps: str) -> Plan:
        left = tuple(s for s in self.stages if s not in steps)
        check(bool(left), "no stage is left")
        return self.only(left)


def validate_trim(t: TrimParams) -> None:
    check(t.window >= 1, "the quality window must be at least 1")
    check(t.quality_right is None or t.quality_tail is None, "quality_right and quality_tail exclude each other")
    check(t.poly_min >= 1 and 0 <= t.poly_rate < 1, "poly tail parameters are out of range")
    check(t.max_length is None or t.max_length >= 1, "max_length must be at least 1")
    check(t.front >= 0 and t.tail >= 0, "fixed trims cannot be negative")


def validate_filter(f: FilterParams) -> None:
    check(f.active, "the filter stage does nothing")
    for name in ("max_n_fraction", "max_unqualified_fraction", "min_complexity"):
        check(getattr(f, name) is None or 0 <= getattr(f, name) <= 1, f"{name} must be within 0 and 1")
    check(f.min_length is None or f.length_limit is None or f.min_length <= f.length_limit, "min_length is over length_limit")


@dataclass(frozen=True)
class SegmentPlan:
    delimiters: tuple[Adapter, ...]
    match: MatchParams = MatchParams()
    options: SegmentParams = SegmentParams()
    trim: TrimParams | None = None
    filter: FilterParams | None = None

    def validate(self, paired: bool) -> SegmentPlan:
        check(not paired, "segmentation takes single-end reads")
        check(bool(self.delimiters), "segmentation needs a delimiter")
        check(self.options.max_fragments >= 1, "max_fragments must be at least 1")
        check(self.options.terminal in ("keep", "discard"), "terminal is keep or discard")
        validate_match(self.match, self.delimiters)
        if self.trim:
            validate_trim(self.trim)
        if self.filter:
            validate_filter(self.filter)
        return self


# Options from a TOML table or keywords: every key must be known.

_SIDE = ("front", "tail", "max_length")


def _only(kind: type, table: dict[str, Any], where: str) -> dict[str, Any]:
    known = {f.name for f in fields(kind)}
    for key in table:
        check(key in known, f"unknown key {where}.{key}")
    return table


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Field by field; lists are replaced whole, None changes nothing."""
    out = dict(base)
    for key, value in over.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = merge(out[key], value)
        elif value is not None:
            out[key] = value
    return out


def plan_from(options: dict[str, Any]) -> Plan:
    """A plan from nested options (umi, correction, overlap, linked, adapter, trim, filter, pair_policy)."""
    _only(Plan, options, "workflow")
    known: dict[str, Any] = {}
    if (u := options.get("umi")) is not None:
        known["umi"] = UmiStage(**_only(UmiStage, u, "umi"))
    if (c := options.get("correction")) is not None:
        known["correction"] = CorrectionParams(**_only(CorrectionParams, c, "correction"))
    if (o := options.get("overlap")) is not None:
        known["overlap"] = OverlapParams(**_only(OverlapParams, o, "overlap"))
    if (a := options.get("adapter")) is not None:
        a = dict(a)
        sides = {side: tuple(Adapter.of(f"{side}_{i}" if isinstance(x, str) else x["name"], x if isinstance(x, str) else x["sequence"]) for i, x in enumerate(a.pop(side, ()))) for side in ("r1", "r2")}
        overlap = bool(a.pop("paired_overlap", False))
        known["adapter"] = AdapterStage(**sides, match=MatchParams(**_only(MatchParams, a, "adapter")), paired_overlap=overlap)
    if (k := options.get("linked")) is not None:
        k = dict(k)
        sides = {side: tuple(Linked(x["five"].upper(), x["three"].upper()) for x in k.pop(side, ())) for side in ("r1", "r2")}
        unmatched = k.pop("unmatched", "continue")
        known["linked"] = LinkedStage(**sides, options=LinkedParams(**_only(LinkedParams, k, "linked")), unmatched=unmatched)
    if (t := options.get("trim")) is not None:
        common = {key: v for key, v in t.items() if key not in [f"{s}_{m}" for s in _SIDE for m in ("r1", "r2")]}
        _only(TrimParams, common, "trim")
        known["trim"] = tuple(TrimParams(**common | {s: t[f"{s}_{m}"] for s in _SIDE if f"{s}_{m}" in t}) for m in ("r1", "r2"))
    if (f := options.get("filter")) is not None:
        known["filter"] = FilterParams(**_only(FilterParams, f, "filter"))
    if (p := options.get("pair_policy")) is not None:
        known["pair_policy"] = p
    return Plan(**known)


def load_toml(path: str | Path) -> dict[str, Any]:
    with open(path, "rb") as f:
        return tomllib.load(f)
