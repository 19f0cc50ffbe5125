"""Session set-up: a default local session, and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and single-machine runs; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("loomline")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application.

    Arrow functions are pickled by reference, so workers must be able to import
    the package even where the driver's path is not theirs.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="loomline-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    stage = os.path.join(folder, "stage")
    shutil.copytree(package, os.path.join(stage, os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "loomline"), "zip", stage))
    _shipped.add(app)
