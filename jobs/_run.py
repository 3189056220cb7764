"""What the jobs share: configuration and command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("evidentia.jobs")


def defaults(job_file: str) -> dict:
    """The configuration that lies beside a job."""
    return json.loads(Path(job_file).with_suffix(".json").read_text(encoding="utf-8"))


def configured(spark: SparkSession, job_file: str, path: str | None) -> dict:
    """The defaults, overridden by those keys that a file (local or remote) gives."""
    held = defaults(job_file)
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := set(given) - set(held):
        raise ValueError(f"unknown keys in {path}: {', '.join(sorted(unknown))}")
    return held | given


def main(name: str, job_file: str, run: Callable, paths: dict[str, str], argv: list[str] | None = None) -> None:
    """Parse the paths, then run the job in a session of its own."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for path, text in paths.items():
        parser.add_argument(f"--{path}", required=True, help=text)
    parser.add_argument("--config", help="JSON file that overrides keys of the configuration beside the job")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, *(getattr(args, path) for path in paths), config=configured(spark, job_file, args.config))
    finally:
        spark.stop()
