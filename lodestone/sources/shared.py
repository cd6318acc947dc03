"""Where tables that outlive a query's stages are written."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir, which all machines share. On one machine
    a temporary folder stands in where none is named; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
