"""Reports as JSON, as plain or coloured text, and as one HTML page without outside requests."""

from __future__ import annotations

import json

from . import health as H
from .findings import SEVERITIES
from .report import by_severity, locator_label, severity_count

NAME = "Evidentia"
ORDER = ("freshness", "duplication", "quality", "risk", "coverage")
PRIVATE = "No chunk text, metadata values, source locators or connection strings are shown."


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)


def shown_locator(locator: str) -> str:
    return locator if " sha256:" in locator else locator_label(locator)


def as_text(report: dict, color: bool = False) -> str:
    def paint(code: str, s: str) -> str:
        return f"\033[{code}m{s}\033[0m" if color else s

    score, totals = report["health"]["score"], report["totals"]
    tone = "32" if score >= 80 else "33" if score >= 60 else "31"
    value = lambda v: " --" if v is None else str(H.whole(v)).rjust(3)
    lines = ["", f"  {paint('1', NAME)}   {paint(tone, f'{score}/100')}  " + paint("2", f"health · RAG rot: {H.rot(score)} · {totals['chunks']} chunks · {totals['sources']} sources")]
    lines.append(paint("2", "  " + "  ".join(f"{k} {value(report['health']['subscores'][k])}" for k in ORDER)))
    tones = {"critical": "31", "warning": "33", "info": "2"}
    for severity, groups in by_severity(report).items():
        if not groups:
            continue
        lines += ["", paint(tones[severity], f"{severity.upper()} ({severity_count(report, severity)})")]
        for kind, some, n in groups:
            lines += [f"  {paint('2', kind)}  {f['title']}" for f in some]
            if n > len(some):
                lines.append(paint("2", f"  {kind}  … +{n - len(some)} more"))
    if report["sources"]:
        lines += ["", paint("1", "Sources"), *(f"  {shown_locator(s['locator'])}  [{s['status']}]" for s in report["sources"])]
    if report["nextActions"]:
        lines += ["", paint("1", "Fix first"), *(f"  {a['rank']}. {a['title']}" for a in report["nextActions"])]
    return "\n".join([*lines, "", paint("2", f"  {PRIVATE}"), ""])


def escaped(s: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = s.replace(a, b)
    return s


STYLE = """
:root { color-scheme: light dark; font: 16px/1.5 system-ui, sans-serif } body { margin: 0; display: grid; grid-template-columns: minmax(14rem, 1fr) 3fr }
nav, main { padding: 1.5rem } nav { border-right: 1px solid #8886 } meter { width: 100% } dt { margin-top: .6rem } dd { margin: 0 }
table { border-collapse: collapse; width: 100% } td { border-top: 1px solid #8886; padding: .4rem; vertical-align: top } pre { white-space: pre-wrap; background: #8882; padding: .5rem }
"""


def as_html(report: dict) -> str:
    """One page without outside requests: health and what to do first on the left, a row for each kind of finding on the right."""
    health, totals = report["health"], report["totals"]
    tag = lambda name, inner, **attrs: f"<{name}{''.join(f' {k}={chr(34)}{v}{chr(34)}' for k, v in attrs.items())}>{inner}</{name}>"

    def gauge(name: str, value: float | None) -> str:
        shown = "not measured" if value is None else str(H.whole(value))
        bar = "" if value is None else tag("meter", "", min=0, max=100, low=60, high=80, optimum=100, value=H.whole(value))
        return tag("dt", f"{name}: {shown}") + tag("dd", bar)

    def finding(f: dict) -> str:
        shown = [json.dumps(f["evidence"], indent=2, ensure_ascii=False)] * bool(f["evidence"]) + [sql for sql in [(f["suggestedRepair"] or {}).get("sql")] if sql]
        return tag("p", escaped(f["title"])) + "".join(tag("pre", escaped(x)) for x in shown)

    def kind_row(severity: str, kind: str, some: list[dict], n: int) -> str:
        more = tag("p", f"and {n - len(some)} more") if n > len(some) else ""
        return tag("tr", tag("td", severity) + tag("td", tag("details", tag("summary", f"{escaped(kind)}, {n}") + "".join(map(finding, some)) + more)))

    rows = "".join(kind_row(severity, *group) for severity, groups in by_severity(report).items() for group in groups)
    counts = ", ".join(f"{severity_count(report, s)} {s}" for s in SEVERITIES)
    places = "".join(tag("tr", "".join(tag("td", escaped(x)) for x in (shown_locator(s["locator"]), s["kind"], s["status"]))) for s in report["sources"])
    first = "".join(tag("li", escaped(a["title"])) for a in report["nextActions"])
    side = tag("h1", f"{health['score']}/100") + tag("p", f"{H.rot(health['score'])} rot in {totals['chunks']} chunks, {escaped(report['stack']['frameworkGuess'] or 'custom')} layout")
    side += tag("dl", "".join(gauge(k, health["subscores"][k]) for k in ORDER)) + (tag("h2", "Begin with") + tag("ol", first) if first else "") + tag("small", PRIVATE)
    body = tag("h2", f"Findings: {counts}") + tag("table", rows) + (tag("h2", f"{totals['sources']} sources") + tag("table", places) if places else "")
    head = '<meta charset="utf-8">' + tag("title", f"{NAME} report") + tag("style", STYLE)
    return "<!doctype html>\n" + tag("html", tag("head", head) + tag("body", tag("nav", side) + tag("main", body)), lang="en")
