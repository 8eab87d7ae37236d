"""This package for the Python workers of executors, which need not have it installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="relspan-"))  # the driver's own; Spark takes it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "relspan_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for inner, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    own = os.path.join(inner, n)
                    z.write(own, os.path.relpath(own, os.path.dirname(package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
