"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir, which driver and executors share. Unset, it is a temporary folder in a single
    process, as in tests, and an error on a cluster, where executors would write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        where = "file://" + tempfile.mkdtemp(prefix="passagemill-")
    return f"{where.rstrip('/')}/scratch-{uuid.uuid4().hex}"
