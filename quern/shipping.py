"""Gives the executors' Python workers this package, whether or not they have it on their path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's files, once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    here = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="quern-zip-")  # on the driver; Spark serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "quern.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(path)
    sc._quern_shipped = True
