"""What the command lines of the jobs share: config files and a session."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import SparkSession

LOG = logging.getLogger("foliant.jobs")


def configured(defaults: dict, file: str | None, given: dict) -> dict:
    """Defaults, overridden by a JSON file, overridden by what the command line gives. Unknown names are an error."""
    found = json.loads(Path(file).read_text()) if file else {}
    unknown = found.keys() - defaults.keys()
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | found | {k: v for k, v in given.items() if v is not None}


def main(run, defaults: dict, paths: list[str], doc: str) -> None:
    """Parses the command line, starts a session, runs the job and stops the session. `paths`: arguments that every run needs."""
    parser = argparse.ArgumentParser(description=doc)
    for name in paths:
        parser.add_argument(f"--{name.replace('_', '-')}", required=True)
    parser.add_argument("--config", help="a JSON file of settings")
    for name, value in defaults.items():
        parser.add_argument(f"--{name.replace('_', '-')}", type=type(value))
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = configured(defaults, args["config"], {k: args[k] for k in defaults})
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, **{p: args[p] for p in paths}, **settings)
    finally:
        spark.stop()
