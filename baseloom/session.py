"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import zipfile
from pathlib import Path
from tempfile import mkdtemp

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch: batches of long texts and of blocks stay small in the JVM and in Python.
ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application: their Python need not have it installed. Arrow batches are bounded unless the session does so."""
    if spark.conf.get(ARROW_BATCH[0], None) is None:
        spark.conf.set(*ARROW_BATCH)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    d = mkdtemp(prefix="baseloom-ship-")  # the driver serves the file for as long as it runs
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    with zipfile.ZipFile(f"{d}/baseloom.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(f"{d}/baseloom.zip")
