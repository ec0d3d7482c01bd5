"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.session import prepare
from foliant.shared import unused_path

#: Tables made by this driver process and not yet deleted.
_MADE: list[str] = []
def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that was never used; what is there goes with `release`, or when Python ends."""
    prepare(spark)
    path = unused_path(spark, name)
    if not _MADE:
        # Registered after the context's own handler, so that it runs before the context stops.
        atexit.register(_release_at_exit)
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes the intermediate tables of this driver process, through the file system they are in, and returns how many
    there were. Results that read from them must be written before."""
    paths, jvm = [_MADE.pop() for _ in range(len(_MADE))], spark._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    local = [p.removeprefix("file://") for p in _MADE if p.startswith("file://")]
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            release(spark)
    for path in local:
        shutil.rmtree(path, ignore_errors=True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame as Parquet and reads it back: cuts the lineage, survives lost executors, and lets readers prune columns."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
