"""Making the package importable where the executors' Python workers run."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of a batch that goes to a Python worker; rows may be long, so rows are no bound.
BATCH_BYTES = 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once for each Spark application, and bound the
    batches of Python workers unless the session has a bound of its own."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp()) / "casegraph"), "zip", root.parent, root.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
