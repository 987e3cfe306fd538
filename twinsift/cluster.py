"""Making the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Rows and bytes that travel to a Python worker at once; a single longer row travels alone.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20

_shipped: set[str] = set()


def small_batches(spark: SparkSession) -> None:
    """Batches that fit small Python workers, however long the rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="twinsift-"), "twinsift.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
