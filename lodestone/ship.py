"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, unless they find it on their path."""
    root = str(Path(__file__).resolve().parent.parent)
    sc = spark.sparkContext
    if sc.applicationId in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = shutil.make_archive(tempfile.mkdtemp(prefix="lodestone-") + "/lodestone", "zip", root, "lodestone")
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
