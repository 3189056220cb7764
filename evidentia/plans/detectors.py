"""Detectors from outside: expressions, aggregates and findings that join the scan's one pass over the chunks."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from .findings import SEVERITIES, TYPES, Finding


class DetectorError(ValueError):
    pass


@dataclass(frozen=True)
class Scanned:
    """What a detector is told beside its own aggregates: rows of the table and rows scanned, and whether these are a sample."""

    table: str
    total: int
    scanned: int
    sampled: bool


@dataclass(frozen=True)
class Detector:
    """A detector that a scan runs with its own.

    id: names it, letters, digits and `_`. columns: new columns by expressions over the chunk view and the features (content_sample, length,
    metadata, thin_reason, ...), each of one chunk. aggregates: of any of these columns over all scanned chunks. Both are prefixed by the id where they
    are kept, and are computed in the pass that counts everything else. findings: from the aggregates' values by name. costs: points that these
    values take off subscores by name, so that the detector weighs in the score; a subscore that cannot be measured stays so.
    """

    id: str
    aggregates: Mapping[str, Column]
    findings: Callable[[dict[str, Any], Scanned], list[Finding]]
    columns: Mapping[str, Column] = field(default_factory=dict)
    costs: Callable[[dict[str, Any], Scanned], dict[str, float]] | None = None

    def __post_init__(self):
        if not self.id.isidentifier():
            raise DetectorError(f"a detector's id has letters, digits and _: {self.id!r}")
        if not self.aggregates:
            raise DetectorError(f"the detector {self.id} has no aggregates")

    def values(self, counted: dict) -> dict[str, Any]:
        return {name: counted[f"{self.id}__{name}"] for name in self.aggregates}


def with_columns(rows: DataFrame, detectors: list[Detector]) -> DataFrame:
    """The features with all detectors' columns; a name that is taken is refused."""
    if len({d.id for d in detectors}) < len(detectors):
        raise DetectorError("two detectors have one id")
    for d in detectors:
        if taken := set(d.columns) & set(rows.columns):
            raise DetectorError(f"the detector {d.id} names columns that are there: {', '.join(sorted(taken))}")
        rows = rows.withColumns(dict(d.columns)) if d.columns else rows
    return rows


def aggregates(detectors: list[Detector]) -> dict[str, Column]:
    return {f"{d.id}__{name}": column for d in detectors for name, column in d.aggregates.items()}


def judge(detectors: list[Detector], counted: dict, scanned: Scanned, subscores: dict[str, float | None]) -> tuple[list[Finding], dict[str, float | None]]:
    """All their findings, and the subscores less what they cost."""
    found, scores = [], dict(subscores)
    for d in detectors:
        values = d.values(counted)
        own = d.findings(values, scanned)
        for f in own:
            if f.type not in TYPES or f.severity not in SEVERITIES:
                raise DetectorError(f"the detector {d.id} tells of an unknown type or severity: {f.type}, {f.severity}")
        found += own
        for name, cost in (d.costs(values, scanned) if d.costs else {}).items():
            if name not in scores:
                raise DetectorError(f"the detector {d.id} takes from an unknown subscore: {name}")
            if scores[name] is not None:
                scores[name] = min(100, max(0, scores[name] - cost))
    return found, scores
