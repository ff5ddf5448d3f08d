"""Session helpers shared by every subpackage."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def make_importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver imported it.

    On a cluster the package is installed on every node (or shipped with
    ``--py-files``) and the extra path is harmless.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])
    return spark


_folders: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path under ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _folders:
            _folders[app] = "file://" + tempfile.mkdtemp(prefix="cohortlens-")
        base = _folders[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a test-data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
