"""The package on the executors: Python workers must import what the driver imports."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application; Spark's own file server hands it out."""
    context = spark.sparkContext
    if getattr(context, "_codeloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="codeloom-ship-")
    target = os.path.join(folder, "codeloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(PACKAGE.rglob("*.py")):
            z.write(file, Path(PACKAGE.name) / file.relative_to(PACKAGE))
    context.addPyFile(target)
    context._codeloom_shipped = True
