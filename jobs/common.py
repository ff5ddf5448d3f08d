"""Settings, counts and paths that the jobs share."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def read_settings(spark: SparkSession, kind: type, path: str | None, given: dict):
    """A settings object from a JSON file (any path that Spark reads) and what the command line gives besides.

    A name that the settings do not have is an error.
    """
    held = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    held |= {k: v for k, v in given.items() if v is not None}
    if unknown := held.keys() - {f.name for f in dataclasses.fields(kind)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**held)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write a partitioned table; only the partitions that ``df`` has are replaced, so that a repeated write changes nothing."""
    df.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def main(name: str, kind: type, run) -> None:
    """The command line of a job: it alone creates and stops a session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    parser.add_argument("--config", help="JSON file of settings")
    for f in dataclasses.fields(kind):
        if f.type == "str":
            parser.add_argument(f"--{f.name.replace('_', '-')}")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, read_settings(spark, kind, given.pop("config"), given))
    finally:
        spark.stop()
