"""What the jobs share: command lines, settings and logs."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, SparkSession

from lectern.plans.models import letters26, transformer_encoder

log = logging.getLogger("jobs")


def settings(name: str, path: str | None = None) -> dict:
    """The job's settings: those of its own file, replaced by those of ``path``. Unknown names are refused."""
    own = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    given = json.loads(Path(path).read_text()) if path else {}
    if unknown := set(given) - set(own):
        raise ValueError(f"{name} has no settings {sorted(unknown)}")
    return own | given


def encoder(name: str) -> Callable[[Column], Column]:
    """``letters26``, the stand-in of the tests, or the name of a sentence transformer."""
    return letters26 if name == "letters26" else transformer_encoder(name)


def command(name: str, paths: dict[str, str], run: Callable[..., dict]) -> None:
    """The command line: one option a path, and --config. It alone makes a session and stops it."""
    told = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=(run.__doc__ or "").splitlines()[0])
    for option, meaning in paths.items():
        told.add_argument(f"--{option}", required=True, help=meaning)
    told.add_argument("--config", help=f"JSON file with settings that replace those of jobs/{name}.json")
    given = vars(told.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = settings(name, given.pop("config"))
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **given, config=config)
    finally:
        spark.stop()
