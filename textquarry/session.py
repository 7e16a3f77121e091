"""Session factory used by the bench, the tests and interactive work."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def build_session(cores: str | int = "*", app: str = "textquarry", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with adaptive execution on and the clock pinned to UTC.

    On a cluster the session comes from the deployment; nothing in the library
    depends on what is set here except the UTC time zone.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("TQ_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session, once.

    The workers import the modules that Arrow functions live in; where the package
    is not installed on the executors, Spark distributes it from the driver.
    """
    context = spark.sparkContext
    if getattr(context, "_textquarry_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="textquarry-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = os.path.join(folder, "textquarry.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as out:
        for where, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(where, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(at)
    context._textquarry_shipped = True  # type: ignore[attr-defined]
