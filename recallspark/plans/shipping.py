"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch, and Spark's own bound: long texts would fill batches of ten thousand rows.
_BATCH, _BATCH_BYTES, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20, 64 << 20


def ensure_on_executors(spark: SparkSession) -> None:
    """Sends the package to the executors once for each application, and bounds Arrow batches in bytes.

    A bound that the session has set itself stays.
    """
    if spark.conf.get(_BATCH).removesuffix("b") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH, str(_BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    stage = tempfile.mkdtemp(prefix="recallspark-")  # on the driver; executors fetch it from Spark's file server
    atexit.register(shutil.rmtree, stage, True)
    shutil.copytree(package, f"{stage}/src/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{stage}/recallspark", "zip", f"{stage}/src"))
    _SHIPPED.add(app)
