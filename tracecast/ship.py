"""Makes the package importable in Python workers that were not started beside it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once per application.

    Arrow batches are bounded by bytes, not by rows alone, where the session does not say how: rows hold whole texts.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "8m")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="tracecast-py-")) / "tracecast"
        spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
        _shipped.add(app)
    return spark
