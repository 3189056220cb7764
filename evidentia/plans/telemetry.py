"""An anonymous summary of a report. It is only built and validated; nothing here sends anything."""

from __future__ import annotations

import hashlib
import json
import platform
import re
from collections import Counter

from ..sources.introspect import RECIPES
from ..sources.mapping import FIELDS, Mapping
from .findings import TYPES

# Results depend on them.
PLAIN_NAMES = ["content", "text", "document", "body", "embedding", "vector", "metadata", "meta", "cmetadata", "metadata_", "id", "node_id", "source", "url", "updated_at", "created_at"]
FRAMEWORKS = ["langchain", "llamaindex", "vecs", "generic", "custom"]
KEYS = {"fingerprintHash", "frameworkGuess", "embeddingDims", "totals", "findingCounts", "healthScore", "mappingShape", "cliVersion", "os"}


def anonymous(name: str | None) -> str | None:
    return name if name is None or name in PLAIN_NAMES else "sha256:" + hashlib.sha256(name.encode()).hexdigest()


def recipe_of(mapping: Mapping) -> str | None:
    """The named recipe whose columns, and joins if it has any, the mapping has."""
    for recipe in RECIPES:
        joins = {k: v for k, v in (mapping.joins or {}).items() if k != "collectionTable"}
        if mapping.columns == recipe.columns and (recipe.joins is None or joins == recipe.joins):
            return recipe.id
    return None


def shape(mapping: Mapping, recipe: str | None = None) -> dict:
    known = recipe or recipe_of(mapping)
    return {"id": known} if known else {"id": "manual", "columns": [{"role": f, "name": anonymous(mapping.columns[f])} for f in FIELDS]}


def build(report: dict, recipe: str | None = None) -> dict:
    guess = report["stack"]["frameworkGuess"]
    payload = {
        "fingerprintHash": report["stack"]["fingerprintHash"], "frameworkGuess": guess if guess in FRAMEWORKS else "unknown", "embeddingDims": report["stack"]["embeddingDims"],
        "totals": {k: report["totals"][k] for k in ("documents", "chunks")}, "findingCounts": {"byType": dict(Counter(f["type"] for f in report["findings"]) + Counter({u["type"]: u["findings"] for u in report.get("unlisted", [])}))},
        "healthScore": report["health"]["score"], "mappingShape": shape(Mapping.from_dict(report["stack"]["mapping"]), recipe),
        "cliVersion": report["scan"].get("cliVersion", "0.0.0"), "os": f"{platform.system().lower()}/{platform.machine()}",
    }
    return validate(payload)


def validate(p: dict) -> dict:
    def count(x) -> bool:
        return isinstance(x, int) and not isinstance(x, bool) and x >= 0

    ok = isinstance(p, dict) and set(p) == KEYS and re.fullmatch("[a-f0-9]{64}", p["fingerprintHash"]) and p["frameworkGuess"] in [*FRAMEWORKS, "unknown"]
    ok = ok and (p["embeddingDims"] is None or (count(p["embeddingDims"]) and p["embeddingDims"] > 0)) and set(p["totals"]) == {"documents", "chunks"} and all(map(count, p["totals"].values()))
    ok = ok and set(p["findingCounts"]) == {"byType"} and all(k in TYPES and count(v) for k, v in p["findingCounts"]["byType"].items()) and count(p["healthScore"]) and p["healthScore"] <= 100
    held = p["mappingShape"] if ok else {}
    if ok and held.get("id") == "manual":
        ok = set(held) == {"id", "columns"} and [c.get("role") for c in held["columns"]] == list(FIELDS)
        ok = ok and all(set(c) == {"role", "name"} and (c["name"] is None or c["name"] in PLAIN_NAMES or re.fullmatch("sha256:[a-f0-9]{64}", c["name"])) for c in held["columns"])
    elif ok:
        ok = set(held) == {"id"} and held["id"] in [*(r.id for r in RECIPES), "generic-single-table"]
    ok = ok and re.fullmatch(r"\d+\.\d+\.\d+(?:[-+][A-Za-z0-9.-]+)?", p["cliVersion"]) and re.fullmatch(r"[A-Za-z0-9_-]{1,32}/[A-Za-z0-9_-]{1,32}", p["os"])
    if not ok:
        raise ValueError("not a telemetry payload")
    return p


def serialize(payload: dict) -> str:
    return json.dumps(validate(payload), separators=(",", ":"), ensure_ascii=False)
