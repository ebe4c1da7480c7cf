"""The package for the executors' Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors through Spark, once for each context, so that it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_has_clusterlake", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", root_dir=package.parent, base_dir=package.name)
    sc.addPyFile(archive)
    sc._has_clusterlake = True
