"""Commands: init, scan, show-telemetry, over a folder of Parquet tables, a catalog database or one behind JDBC."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from .operators.features import Thresholds
from .plans import findings, render, report, telemetry
from .plans.scan import Limits, scan
from .sources import config as C
from .sources.catalog import Catalog
from .sources.introspect import Prompts, introspect, stack_of
from .sources.jdbc import POSTGRESQL, Database, Dialect
from .sources.mapping import Mapping

VERSION = "0.1.0"
MIN_SCORE = 70


def open_catalog(spark: SparkSession, source: str | None, env: str = "DATABASE_URL", dialect: Dialect = POSTGRESQL) -> Catalog:
    """source: a folder of *.parquet tables, a database of the session catalog, or a connection (jdbc:... or
    postgresql://...); without one, the connection that the environment variable `env` holds."""
    if source is None:
        if not os.environ.get(env):
            raise ValueError(f"no source is given and {env} is not set")
        return Database(spark, os.environ[env], dialect)
    if source.startswith(("jdbc:", "postgres://", "postgresql://")):
        return Database(spark, source, dialect)
    folder = Path(source)
    if folder.is_dir():
        return Catalog.of_parquet(spark, {p.name.removesuffix(".parquet"): str(p) for p in sorted(folder.glob("*.parquet"))})
    return Catalog.of_database(spark, source)


def terminal_prompts(read: Callable[[str], str] = input, say: Callable[[str], None] = print) -> Prompts:
    """Questions on a terminal: yes or no, one of a numbered list, or none of it."""

    def choose(message: str, choices: list[str], none: bool) -> str | None:
        say(message)
        for k, choice in enumerate(choices, 1):
            say(f"  {k}. {choice}")
        while True:
            given = read("number, or nothing for none: " if none else "number: ").strip()
            if none and not given:
                return None
            if given.isdigit() and 1 <= int(given) <= len(choices):
                return choices[int(given) - 1]
            if given in choices:
                return given

    return Prompts(lambda m: read(f"{m} [Y/n] ").strip().lower() in ("", "y", "yes"), lambda m, cs: choose(m, cs, False), lambda m, cs: choose(m, cs, True))


def settings(config: dict | None) -> tuple[Thresholds, Limits]:
    held, base, limits = (config or {}).get("thresholds", {}), Thresholds(), Limits()
    return (
        Thresholds(held.get("nearDuplicateCosine", base.near_duplicate_cosine), held.get("thinChunkMinChars", base.thin_chunk_min_chars), held.get("linkNavDensity", base.link_nav_density)),
        Limits(held.get("maxChunks", limits.max_chunks), held.get("nearDupProbes", limits.near_dup_probes)),
    )


def run_init(spark: SparkSession, source: str | None, folder: str = ".", system: str = "my-rag", env: str = "DATABASE_URL", force: bool = False, prompts: Prompts | None = None, dialect: Dialect = POSTGRESQL) -> tuple[dict, bool]:
    """Find a mapping and write it down; a configuration that has one stays unless forced. Without prompts what is found is
    taken. The configuration, and whether it is new."""
    held = C.load(folder)
    if held and held.get("mapping") and not force:
        return held, False
    found = introspect(open_catalog(spark, source, env, dialect), prompts, yes=prompts is None)
    fresh = {"version": 1, "system": {"name": system}, "connection": {"env": env}, "mapping": found.mapping.to_dict()}
    C.save(fresh, folder)
    return C.validate(fresh), True


def run_scan(
    spark: SparkSession, source: str | None, key: str, folder: str = ".", system: str = "my-rag", env: str = "DATABASE_URL", min_score: int = MIN_SCORE, ci: bool = False, prompts: Prompts | None = None,
    dialect: Dialect = POSTGRESQL,
) -> tuple[dict, int, str | None]:
    """The report, the exit code, and the recipe if the mapping was found just now (and, with prompts, agreed to)."""
    held = C.load(folder)
    env = (held or {}).get("connection", {}).get("env", env)
    catalog, recipe = open_catalog(spark, source, env, dialect), None
    if held and held.get("mapping"):
        mapping = Mapping.from_dict(held["mapping"])
        stack = stack_of(catalog, mapping)
    else:
        found = introspect(catalog, prompts, yes=prompts is None)
        mapping, stack, recipe = found.mapping, found.stack, found.recipe
        C.save({"version": 1, "system": {"name": system}, "connection": {"env": env}, "mapping": mapping.to_dict()}, folder)
    thresholds, limits = settings(held)
    expected = (held or {}).get("inventory")
    expected = findings.Inventory(expected.get("minChunks"), expected.get("minDocuments")) if expected else None
    started = datetime.now(UTC).isoformat()
    indexes = catalog.indexes(mapping.table)
    indexes = None if indexes is None else [findings.IndexInfo(*i) for i in indexes]
    with catalog.snapshot():
        result = scan(catalog.keyed(mapping.table, key), mapping, key, system=(held or {}).get("system", {}).get("name", system), thresholds=thresholds, limits=limits, inventory=expected, indexes=indexes)
    out = report.build(result, mapping, stack, started, datetime.now(UTC).isoformat(), (held or {}).get("sources"), VERSION)
    return out, int(ci and out["health"]["score"] < min_score), recipe


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evidentia")
    parser.add_argument("command", choices=["init", "scan", "show-telemetry"])
    parser.add_argument("source", nargs="?", help="folder of Parquet tables, a database of the session, or a connection; without it, the connection that the environment holds")
    parser.add_argument("--key", default="id", help="column that names a chunk")
    parser.add_argument("--dir", default=".")
    parser.add_argument("--name", default="my-rag")
    parser.add_argument("--connection-env", default="DATABASE_URL")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--yes", action="store_true", help="take the mapping that is found without asking")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--html")
    parser.add_argument("--ci", action="store_true")
    parser.add_argument("--min-score", type=int, default=MIN_SCORE)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("evidentia").getOrCreate()
    prompts = None if given.yes or not sys.stdin.isatty() else terminal_prompts()
    if given.command == "init":
        _, new = run_init(spark, given.source, given.dir, given.name, given.connection_env, given.force, prompts)
        print("configuration written" if new else "configuration kept", file=sys.stderr)
        return 0
    held, code, recipe = run_scan(spark, given.source, given.key, given.dir, given.name, given.connection_env, given.min_score, given.ci, prompts)
    if given.command == "show-telemetry":
        print(telemetry.serialize(telemetry.build(held, recipe)))
        return 0
    print(render.as_json(held) if given.json else render.as_text(held, sys.stdout.isatty()))
    if given.html:
        Path(given.html).write_text(render.as_html(held), encoding="utf-8")
        print(f"HTML report: {given.html}", file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
