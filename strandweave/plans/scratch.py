"""A folder for files between the steps of a query."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local master may do without and gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="strandweave-")
    atexit.register(shutil.rmtree, base, True)
    spark.sparkContext.setCheckpointDir(base)
    return "file://" + base
