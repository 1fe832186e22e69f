"""Prepares a session for Python workers: the package is importable there, and batches are bounded by bytes."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once a Spark context.

    Arrow batches get a bound of 1 MB, unless the session sets one itself: with
    the default of 64 MB, long texts fill the memory beside the heap, where the
    JVM's and the workers' copies of a batch stand. A longer text is a batch by itself.
    """
    context = spark.sparkContext
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, "1m")
    if getattr(context, "_siftwell_shipped", False):
        return
    home = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="siftwell-"), "siftwell.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(home.rglob("*.py")):
            out.write(p, str(Path(home.name) / p.relative_to(home)))
    context.addPyFile(path)
    context._siftwell_shipped = True
