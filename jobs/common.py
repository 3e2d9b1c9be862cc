"""What both jobs share: settings, the command line, the log."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import SparkSession


def settings(spark: SparkSession, path: str | None, beside: str) -> dict:
    """The settings of a job: those in the JSON file beside it, with what the file at ``path`` (read by Spark) says in their place."""
    out = json.loads(Path(beside).with_suffix(".json").read_text(encoding="utf-8"))
    if path:
        given = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        if unknown := set(given) - set(out):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out |= given
    return out


def command_line(name: str, doc: str, paths: Sequence[str], run: Callable[..., dict]) -> None:
    """Parse the paths, start a session, run, stop it. Only here a session is made."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=doc)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="JSON file of settings that differ from those beside the job")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    env, home = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    env["PYTHONPATH"] = os.pathsep.join([home, *filter(None, env.get("PYTHONPATH", "").split(os.pathsep))])
    try:
        run(spark, **given)
    finally:
        spark.stop()
