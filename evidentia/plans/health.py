"""Subscores and the health score, in IEEE doubles and in a fixed order of terms."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

# Results depend on them.
WEIGHTS = {"freshness": 0.3, "duplication": 0.2, "quality": 0.2, "risk": 0.1, "coverage": 0.2}
SCORE_VERSION = 1


def rounded(x: float, digits: int = 0) -> float | int:
    """Decimal digits of the exact binary value, ties up."""
    out = Decimal(float(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
    return int(out) if out == out.to_integral_value() else float(out)


def whole(x: float) -> int:
    return math.floor(x + 0.5)


def pct(part: float, total: float) -> float:
    return part / total * 100 if total > 0 else 0.0


def freshness(stale_pct: float | None) -> float | None:
    return None if stale_pct is None else 100 - min(100, stale_pct * 2)


def duplication(exact_pct: float, near_pct: float) -> float:
    return 100 - min(100, (exact_pct + near_pct) * 2.5)


def quality(thin_and_large_pct: float) -> float:
    return 100 - min(100, thin_and_large_pct * 2)


def risk(critical: int, warning: int) -> int:
    return max(0, 100 - 25 * critical - 5 * warning)


def coverage(passed: int, total: int) -> float | None:
    return passed / total * 100 if total > 0 else None


def score(subscores: dict[str, float | None]) -> int:
    """The weighted mean; the weight of what cannot be measured goes to the others in proportion."""
    measured = [(w, subscores[k]) for k, w in WEIGHTS.items() if subscores[k] is not None]
    total = 0.0
    for w, _ in measured:
        total += w
    out = 0.0
    for w, value in measured:
        out += w / total * value
    return whole(out)


def rot(value: int) -> str:
    return "none" if value >= 90 else "light" if value >= 80 else "noticeable" if value >= 60 else "severe"
