"""The report: findings with capped evidence, totals, health, ranked next actions; and its validation."""

from __future__ import annotations

import hashlib
import re
import uuid
from datetime import datetime
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.freshness import locator_hash
from ..sources.mapping import Mapping, MappingError
from . import findings as N
from .scan import ScanResult

# Results depend on them.
EVIDENCE_CHARS, ACTIONS, SHOWN_PER_TYPE = 500, 5, 5
RANK = {s: i for i, s in enumerate(N.SEVERITIES)}


def capped(value):
    """Every string in a JSON value cut to EVIDENCE_CHARS; keys stay."""
    if isinstance(value, str):
        return value[:EVIDENCE_CHARS]
    if isinstance(value, (list, tuple)):
        return [capped(v) for v in value]
    if isinstance(value, dict):
        return {k: capped(v) for k, v in value.items()}
    return value


def locator_label(locator: str) -> str:
    """A source's kind of address and a hash: never the address."""
    parts = urlsplit(locator) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", locator) else None
    prefix = f"{parts.scheme.lower()} source" if parts and parts.scheme else "source"
    return f"{prefix} sha256:{hashlib.sha256(locator.encode()).hexdigest()[:16]}"


def label_column(locator: Column) -> Column:
    """locator_label as an expression, for tables of any size; a null has none."""
    scheme = F.lower(F.regexp_extract(locator, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(" source "))).otherwise(F.lit("source ")), locator_hash(locator))


def action_key(finding: dict) -> str:
    if finding["suggestedRepair"]:
        return finding["suggestedRepair"]["kind"]
    return finding["type"] if finding["type"] in ("exact_duplicate", "near_duplicate") else f"{finding['type']}:{finding['title']}"


def ranked(findings: list[dict], unlisted: list[dict]) -> list[dict]:
    """Findings grouped by what to do, the most severe and widest groups first, five at most: title, refs
    (of those listed) and n (with those that are only counted)."""
    groups: dict[str, dict] = {}
    for i, f in enumerate(findings):
        g = groups.setdefault(action_key(f), {"worst": f, "refs": [], "n": 0, "affected": 0})
        g["refs"].append(i)
        g["n"] += 1
        g["affected"] += f["affectedCount"]
        if RANK[f["severity"]] < RANK[g["worst"]["severity"]]:
            g["worst"] = f
    for u in unlisted:
        # Only kinds of which some are listed have unlisted ones, and no repair of their own.
        if g := groups.get(f"{u['type']}:{u.get('title')}") or groups.get(u["type"]) or next((g for g in groups.values() if g["worst"]["type"] == u["type"]), None):
            g["n"] += u["findings"]
            g["affected"] += u["affectedCount"]
    best = sorted(groups.values(), key=lambda g: (RANK[g["worst"]["severity"]], -g["affected"]))[:ACTIONS]
    return [{"title": g["worst"]["title"], "refs": g["refs"], "n": g["n"]} for g in best]


def next_actions(findings: list[dict], unlisted: list[dict] | None = None) -> list[dict]:
    """The ranked groups of findings, with references to those listed."""
    return [{"rank": k + 1, "title": g["title"], "findingRefs": g["refs"]} for k, g in enumerate(ranked(findings, unlisted or []))]


def by_severity(report: dict) -> dict[str, list[tuple[str, list[dict], int]]]:
    """For each severity its types in order of appearance: (type, first findings, how many there are, listed or not)."""
    out: dict[str, dict[str, list[dict]]] = {s: {} for s in N.SEVERITIES}
    for f in report["findings"]:
        out[f["severity"]].setdefault(f["type"], []).append(f)
    return {s: [(t, held[:SHOWN_PER_TYPE], len(held) + unlisted_count(report, s, t)) for t, held in types.items()] for s, types in out.items()}


def unlisted_count(report: dict, severity: str | None = None, kind: str | None = None) -> int:
    return sum(u["findings"] for u in report.get("unlisted", []) if severity in (None, u["severity"]) and kind in (None, u["type"]))


def severity_count(report: dict, severity: str) -> int:
    return sum(f["severity"] == severity for f in report["findings"]) + unlisted_count(report, severity)


def build(result: ScanResult, mapping: Mapping, stack: dict, started: str, finished: str, sources: list[dict] | None = None, version: str | None = None) -> dict:
    """stack: fingerprintHash, frameworkGuess, embeddingDims, embeddingModelGuess."""
    found = []
    for f in (x.to_dict() for x in result.findings):
        f["evidence"] = capped(f["evidence"])
        if f["suggestedRepair"]:
            f["suggestedRepair"] = f["suggestedRepair"] | {"description": f["suggestedRepair"]["description"][:EVIDENCE_CHARS]}
        found.append(f)
    sources = sources or []
    unlisted = [u.to_dict() for u in result.unlisted]
    report = {
        "version": 1,
        "scan": {"id": str(uuid.uuid4()), "origin": "cli", "startedAt": started, "finishedAt": finished} | ({"cliVersion": version} if version else {}),
        "stack": {k: stack.get(k) for k in ("fingerprintHash", "frameworkGuess", "embeddingDims", "embeddingModelGuess")} | {"mapping": mapping.to_dict()},
        "totals": result.totals | {"sources": len(sources)},
        "health": {"score": result.score, "scoreVersion": 1, "subscores": result.subscores},
        "findings": found,
        "sources": [{"locator": locator_label(s["locator"]), "kind": s["kind"], "lastIndexedAt": None, "lastChangedAt": None, "status": "unknown"} for s in sources],
        "nextActions": next_actions(found, unlisted),
    } | ({"unlisted": unlisted} if unlisted else {})
    validate(report)
    return report


class ReportError(ValueError):
    pass


def need(ok: bool, what: str) -> None:
    if not ok:
        raise ReportError(what)


def is_int(x, low: int | None = None, high: int | None = None) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and (low is None or x >= low) and (high is None or x <= high)


def is_number(x, low: float, high: float) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and low <= x <= high


def is_time(x) -> bool:
    """An ISO 8601 time with an offset."""
    try:
        return isinstance(x, str) and "T" in x and datetime.fromisoformat(x).tzinfo is not None
    except ValueError:
        return False


def is_uuid(x) -> bool:
    try:
        return isinstance(x, str) and str(uuid.UUID(x)) == x.lower()
    except ValueError:
        return False


def is_json(x) -> bool:
    if isinstance(x, dict):
        return all(isinstance(k, str) and is_json(v) for k, v in x.items())
    return all(map(is_json, x)) if isinstance(x, list) else x is None or isinstance(x, (str, int, float, bool))


def text(x) -> bool:
    return isinstance(x, str) and x != ""


def validate(report: dict) -> dict:
    """Refuse a report that is not of the contract; return it."""
    need(isinstance(report, dict) and report.get("version") == 1, "version is 1")
    for part in ("scan", "stack", "totals", "health"):
        need(isinstance(report.get(part), dict), f"{part} is an object")
    for part in ("findings", "sources", "nextActions"):
        need(isinstance(report.get(part), list), f"{part} is a list")
    scan, stack, health = report["scan"], report["stack"], report["health"]
    need(is_uuid(scan.get("id")) and scan.get("origin") in ("cli", "cloud"), "scan has an id and an origin")
    need(is_time(scan.get("startedAt")) and is_time(scan.get("finishedAt")), "scan has times")
    need("cliVersion" not in scan or isinstance(scan["cliVersion"], str), "cliVersion is text")
    need(text(stack.get("fingerprintHash")), "fingerprintHash is text")
    need(stack.get("frameworkGuess") is None or isinstance(stack["frameworkGuess"], str), "frameworkGuess is text or null")
    need(stack.get("embeddingDims") is None or is_int(stack["embeddingDims"], 1), "embeddingDims is positive or null")
    need(stack.get("embeddingModelGuess") is None or isinstance(stack["embeddingModelGuess"], str), "embeddingModelGuess is text or null")
    try:
        Mapping.from_dict(stack.get("mapping"))
    except MappingError as e:
        raise ReportError(str(e)) from e
    need(all(is_int(report["totals"].get(k), 0) for k in ("documents", "chunks", "sources")), "totals are counts")
    need(is_int(health.get("score"), 0, 100) and health.get("scoreVersion") == 1, "score is 0 to 100")
    held = health.get("subscores")
    need(isinstance(held, dict) and all(is_number(held.get(k), 0, 100) for k in ("duplication", "quality", "risk")), "subscores are 0 to 100")
    need(all(held.get(k) is None or is_number(held[k], 0, 100) for k in ("freshness", "coverage")), "subscores are 0 to 100 or null")
    if "delta" in health:
        need(is_int(health["delta"].get("previousScore"), 0, 100) and is_time(health["delta"].get("previousScanAt")), "delta has a score and a time")
    for f in report["findings"]:
        need(f.get("type") in N.TYPES and f.get("severity") in N.SEVERITIES and text(f.get("title")), "a finding has a known type and severity, and a title")
        need(isinstance(f.get("evidence"), dict) and is_json(f["evidence"]) and is_int(f.get("affectedCount", 1), 1), "a finding has evidence and a count")
        what = f.get("suggestedRepair")
        need(what is None or (text(what.get("kind")) and text(what.get("description")) and isinstance(what.get("sql", ""), str)), "a repair has a kind and a description")
    for s in report["sources"]:
        need(text(s.get("locator")) and text(s.get("kind")) and s.get("status") in ("fresh", "stale", "unknown"), "a source has a locator, a kind and a status")
        need(all(s.get(k) is None or is_time(s[k]) for k in ("lastIndexedAt", "lastChangedAt")), "a source's times are times or null")
    for a in report["nextActions"]:
        need(is_int(a.get("rank"), 1) and isinstance(a.get("title"), str) and all(is_int(i, 0) for i in a.get("findingRefs", [None])), "an action has a rank, a title and references")
    return report


def findings_frame(spark, report: dict):
    """The findings as a table, for any sink: index, type, severity, title, evidence and repair (JSON), affected."""
    import json

    rows = [(i, f["type"], f["severity"], f["title"], json.dumps(f["evidence"], ensure_ascii=False), json.dumps(f["suggestedRepair"], ensure_ascii=False) if f["suggestedRepair"] else None, f["affectedCount"]) for i, f in enumerate(report["findings"])]
    return spark.createDataFrame(rows, "idx int, type string, severity string, title string, evidence string, repair string, affected long")
