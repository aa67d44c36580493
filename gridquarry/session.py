"""Making this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each context, as `spark-submit --py-files` would."""
    context = spark.sparkContext
    if getattr(context, "_gridquarry_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="gridquarry-"), "gridquarry_sources.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("gridquarry", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._gridquarry_shipped = True
