"""Give the executors this package, as ``--py-files`` would."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package once per application; sessions run in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="mendframe-"), "mendframe.zip")
    root = os.path.dirname(PACKAGE)
    with zipfile.ZipFile(archive, "w") as bundle:
        for folder, _, files in os.walk(PACKAGE):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
