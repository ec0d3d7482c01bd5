"""The folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Used where spark.checkpoint.dir is unset, and then only when the executors are in this machine.
LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only for a local master without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{LOCAL_DIR}"


def unused_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that was never used."""
    return f"{shared_dir(spark)}/foliant-{name}-{uuid.uuid4().hex}"
