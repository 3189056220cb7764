"""The configuration file: validated on reading and writing; it names where a connection is kept, never the connection."""

from __future__ import annotations

from pathlib import Path

from .mapping import Mapping

FILE = "evidentia.yaml"
SOURCE_KINDS = ["website", "sitemap", "github_repo", "files", "manual"]
SHARES, COUNTS = ("nearDuplicateCosine", "linkNavDensity"), ("thinChunkMinChars", "maxChunks", "nearDupProbes")


class ConfigError(ValueError):
    pass


def need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


def count(x, low: int) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= low


def validate(data: dict) -> dict:
    """The configuration with its defaults; unknown keys are dropped."""
    need(isinstance(data, dict) and data.get("version") == 1, "version is 1")
    out: dict = {"version": 1}
    for part, key in (("system", "name"), ("connection", "env")):
        held = data.get(part)
        need(isinstance(held, dict) and isinstance(held.get(key), str) and held[key] != "", f"{part}.{key} is text")
        out[part] = {key: held[key]}
    if data.get("mapping") is not None:
        out["mapping"] = Mapping.from_dict(data["mapping"]).to_dict()
    if data.get("sources") is not None:
        need(isinstance(data["sources"], list), "sources is a list")
        for s in data["sources"]:
            need(isinstance(s, dict) and s.get("kind") in SOURCE_KINDS and isinstance(s.get("locator"), str) and s["locator"] != "", "a source has a known kind and a locator")
        out["sources"] = [{"kind": s["kind"], "locator": s["locator"]} for s in data["sources"]]
    if data.get("inventory") is not None:
        held = {k: data["inventory"][k] for k in ("minChunks", "minDocuments") if data["inventory"].get(k) is not None}
        need(bool(held) and all(count(v, 0) for v in held.values()), "inventory has minChunks or minDocuments")
        out["inventory"] = held
    if data.get("sync") is not None:
        held = data["sync"]
        need(isinstance(held, dict) and isinstance(held.get("enabled", False), bool), "sync.enabled is true or false")
        need("apiUrl" not in held or str(held["apiUrl"]).startswith(("http://", "https://")), "sync.apiUrl is an address")
        out["sync"] = {"enabled": held.get("enabled", False)} | ({"apiUrl": held["apiUrl"]} if "apiUrl" in held else {})
    need(isinstance(data.get("telemetry", False), bool), "telemetry is true or false")
    out["telemetry"] = data.get("telemetry", False)
    if data.get("thresholds") is not None:
        held = data["thresholds"]
        need(isinstance(held, dict), "thresholds is an object")
        for k in SHARES:
            need(held.get(k) is None or (isinstance(held[k], (int, float)) and not isinstance(held[k], bool) and 0 <= held[k] <= 1), f"{k} is 0 to 1")
        for k in COUNTS:
            need(held.get(k) is None or count(held[k], 1), f"{k} is a positive number")
        out["thresholds"] = {k: held[k] for k in (*SHARES, *COUNTS) if held.get(k) is not None}
    return out


def load(folder: str = ".") -> dict | None:
    """The configuration and, under telemetryConfigured, whether the file says anything of telemetry; null without a file."""
    import yaml

    path = Path(folder, FILE)
    if not path.exists():
        return None
    raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    return validate(raw) | {"telemetryConfigured": isinstance(raw, dict) and "telemetry" in raw}


def save(config: dict, folder: str = ".") -> str:
    """Write what is valid; telemetry only if it was given."""
    import yaml

    held = validate(config)
    if "telemetry" not in config:
        del held["telemetry"]
    path = Path(folder, FILE)
    path.write_text("# connection.env names where the connection is kept; the connection itself never stands here.\n" + yaml.safe_dump(held, sort_keys=False, allow_unicode=True), encoding="utf-8")
    return str(path)
