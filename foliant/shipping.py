"""Makes the package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "_foliant_shipped"


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the context, once; Spark hands them to every executor. The driver's copy goes when Python ends."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="foliant-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "foliant.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    setattr(context, _SHIPPED, True)
