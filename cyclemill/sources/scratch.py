"""Folders that the driver and all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="cyclemill-")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temp folder (local mode) or the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.partition("[")[0] == "local"
        base = _local_dir() if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/cyclemill-{uuid.uuid4().hex}"
