"""What a session needs before a stage of this subpackage runs in Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from foliant.shipping import ship

#: Rows and bytes of an Arrow batch: Spark's defaults, and what is set instead. The defaults take some hundreds of MB outside the heap, which executors keep.
SMALLER = {"spark.sql.execution.arrow.maxRecordsPerBatch": (10_000, "256"), "spark.sql.execution.arrow.maxBytesPerBatch": (64 << 20, "8m")}


def prepare(spark: SparkSession) -> None:
    """Ships the package. Where the session has Spark's default for rows or bytes of an Arrow batch, a smaller number is set, for good: plans are made when
    results are asked for, so it cannot be set for one stage."""
    for name, (usual, smaller) in SMALLER.items():
        if spark.conf.get(name).removesuffix("b") == str(usual):
            spark.conf.set(name, smaller)
    ship(spark)
