"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import lobloom

_SHIPPED: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_000


def ensure_importable(spark: SparkSession) -> None:
    """Sends the package to the workers with ``addPyFile`` unless their path already has it.

    Workers start in the application's folder with its ``PYTHONPATH``; a package
    that the driver found by other means has to be sent, once per application. Rows
    hold whole texts here, so Arrow batches get ``BATCH_ROWS`` rows where the session
    has Spark's 10,000, which would be tens of megabytes on either side of each worker.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))
    package = os.path.dirname(os.path.abspath(lobloom.__file__))
    root = os.path.dirname(package)
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or any(p and os.path.realpath(p) == os.path.realpath(root) for p in known):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-lobloom-"), "lobloom_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
