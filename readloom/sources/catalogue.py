"""Adapters by name: the known ones, catalogue files, FASTA, and categories."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from pathlib import Path

from readloom.plans.config import Adapter, check
from readloom.sources import known


@dataclass(frozen=True)
class Entry:
    name: str
    r1: str
    r2: str | None = None

    def sequence_of(self, mate: str) -> str:
        """R2 falls back on R1's sequence."""
        return self.r2 if mate == "R2" and self.r2 else self.r1

    @property
    def category(self) -> str:
        low = self.name.lower()
        return "control" if "phix" in low else "primer" if "primer" in low else "adapter"


def load(path: str | Path | None = None) -> list[Entry]:
    """The known sequences, or those of a file: name, r1 and r2 (may be empty) of each line, or FASTA."""
    if path is None:
        return [Entry(*row) for row in known.entries()]
    if Path(path).suffix in (".fa", ".fasta"):
        return [Entry(a.name, a.sequence) for a in read_fasta(path)]
    with open(path, newline="") as f:
        rows = list(csv.DictReader(f))
    return [Entry(r["name"], Adapter.of(r["name"], r["r1"]).sequence, Adapter.of(r["name"], r["r2"]).sequence if r.get("r2") else None) for r in rows]


def read_fasta(path: str | Path) -> list[Adapter]:
    """Records of a FASTA file: the name is the first token; sequences may span lines; blank lines are skipped."""
    names: list[str] = []
    parts: list[list[str]] = []
    for raw in Path(path).read_text().splitlines():
        line = raw.strip()
        if not line:
            continue
        if line.startswith(">"):
            tokens = line[1:].split()
            check(bool(tokens), f"{path}: a record has no name")
            names.append(tokens[0])
            parts.append([])
        else:
            check(bool(names), f"{path}: sequence before the first header")
            parts[-1].append(line)
    check(bool(names), f"{path}: no records")
    return [Adapter.of(n, "".join(p)) for n, p in zip(names, parts, strict=True)]
