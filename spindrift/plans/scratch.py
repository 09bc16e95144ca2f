"""Folders for what registered queries write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path: under the session's spark.checkpoint.dir, which all machines share; without one a temporary folder of this
    machine, which does only where the executors are here too."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='spindrift-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
