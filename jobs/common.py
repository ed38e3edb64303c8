"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path


def main(run: Callable[..., dict], name: str, paths: list[str]) -> None:
    """Read the config file, let path arguments win over it, and run with a session of this process's own."""
    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")), help="JSON file of settings")
    for p in paths:
        parser.add_argument(f"--{p}", help=f"path of {p}, in place of the config file's")
    args = vars(parser.parse_args())
    settings = json.loads(Path(args.pop("config")).read_text()) | {k: v for k, v in args.items() if v is not None}
    if missing := [p for p in paths if not settings.get(p)]:
        parser.error(f"no path for: {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **settings)
    finally:
        spark.stop()
